"""External services behind injected transports: speech synthesis and batch transcription.

A transport is a function (method, url, headers, body) -> (status, bytes). Keys go into headers only,
never into results, messages or states; transports must not follow redirects.
"""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote, urlsplit

from cadenza.operators.validate import InvalidData

Transport = Callable[[str, str, Mapping[str, str], bytes | None], tuple[int, bytes]]

# Fixed values of the services: answers that end a run, final job states, the form of a key, seconds to wait
STOPPING = (401, 402, 403, 429)
DONE = ("Completed", "PartiallyCompleted", "Failed")
KEY = re.compile(r"[A-Za-z0-9._~+/-]{32,512}={0,2}")
WAIT, POLL = 10, 5

_PLAIN = re.compile(r"(?P<scheme>https?)://(?P<host>\[[0-9A-Fa-f:]+\]|[^/?#@:\[\]\s]+)(:[0-9]+)?(/[^?#\s]*)?")
_HERE = {"localhost", "127.0.0.1", "[::1]"}


def check_url(url: str) -> re.Match:
    """A plain HTTP(S) address: scheme, host, port and path only."""
    found = _PLAIN.fullmatch(url)
    if not found:
        raise InvalidData("the address must be plain http(s), without credentials, query or fragment")
    return found


def endpoint(base: str, *path: str) -> str:
    """A checked address with path parts appended, whether or not it ends in a slash."""
    check_url(base)
    return "/".join([base.rstrip("/"), *path])


def key_headers(url: str, env: Mapping[str, str] = os.environ, name: str = "TTS_API_KEY") -> dict[str, str]:
    """The authorization header, from a variable or a file but not both; only over HTTPS or to this machine."""
    address = check_url(url)
    sources = {k: env[k] for k in (name, f"{name}_FILE") if env.get(k, "").strip()}
    if len(sources) > 1:
        raise InvalidData(f"set one of {' and '.join(sources)}")
    if not sources:
        return {}
    ((source, told),) = sources.items()
    key = told.strip() if source == name else Path(told).read_text(encoding="utf-8").strip()
    if not KEY.fullmatch(key):
        raise InvalidData("the key is empty or has another form")
    if address["scheme"] != "https" and address["host"] not in _HERE:
        raise InvalidData("a key needs HTTPS")
    return {"Authorization": f"Bearer {key}"}


class Refused(RuntimeError):
    """The service refused in a way that stops the run (access, payment, quota)."""


def retried(call: Callable[[], tuple[int, bytes]], sleep: Callable[[float], None] = time.sleep, tries: int = 4, give_up: Callable[[bytes], bool] = lambda body: False) -> tuple[int, bytes]:
    """Again after 10, 20, 30 seconds while the answer is 429."""
    for n in range(1, tries + 1):
        status, body = call()
        if status != 429 or n == tries or give_up(body):
            break
        sleep(WAIT * n)
    return status, body


def voice_of(mode: str, lang: str | None) -> str | None:
    """A system's voice for a language: its default female one, the English one, or a named preset; none for ''."""
    return {"": None, "lang_female": f"{lang}_female_default", "en_default": "en_female_default"}.get(mode, mode)


@dataclass
class Synthesizer:
    url: str
    transport: Transport
    headers: Mapping[str, str] = field(default_factory=dict)
    body: Callable[[Mapping], dict] = dict
    decode: Callable[[bytes], bytes] = bytes
    sleep: Callable[[float], None] = time.sleep

    def speak(self, item: Mapping) -> dict:
        """status ok with the WAV and its seconds, or failed with an error type and HTTP status."""
        from cadenza.functions.audio import parse

        status = None
        try:
            sent = json.dumps(self.body(item), ensure_ascii=False).encode()
            status, raw = retried(lambda: self.transport("POST", self.url, {"Content-Type": "application/json", **self.headers}, sent), self.sleep)
            if status != 200:
                raise RuntimeError(f"HTTP {status}")
            wav = self.decode(raw)
            told = parse(wav)
            if not told or not told["frames"] or told["truncated"] or (told["channels"], told["sample_width"], told["rate"]) != (1, 2, 24_000):
                raise InvalidData("expected whole mono 16-bit audio at 24 kHz")
            return {"status": "ok", "content": wav, "audio_seconds": told["frames"] / told["rate"]}
        except Exception as e:  # a clip's failure is data here; bodies and headers are left out
            return {"status": "failed", "error_type": type(e).__name__, "http_status": status}


class BatchTranscriber:
    """A job for each batch: created once, fed, started, awaited, collected.

    ``store``: a mapping from batch key to state that survives restarts. The state is written before
    the job is created; if the outcome of creation isn't known, the job is not created again.
    """

    def __init__(self, api: str, transport: Transport, key: str, store, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.api, self.transport, self.key, self.store, self.sleep, self.clock = api, transport, key, store, sleep, clock

    def _call(self, method: str, path: str = "", body: dict | None = None) -> dict:
        sent = None if body is None else json.dumps(body).encode()
        headers = {"api-subscription-key": self.key, "Content-Type": "application/json"}
        status, raw = retried(lambda: self.transport(method, self.api + path, headers, sent), self.sleep, give_up=lambda b: _code(b) == "insufficient_quota_error")
        if not 200 <= status < 300:
            code = _code(raw)
            raise Refused(f"HTTP {status}: {code if re.fullmatch('[a-z_]+', code) else 'unknown'}")
        return json.loads(raw)

    def _store(self, method: str, url: str, body: bytes | None = None, blob: bool = False) -> bytes:
        """Storage never gets the key, and only over HTTPS."""
        if urlsplit(url).scheme != "https":
            raise InvalidData("storage needs HTTPS")
        headers = {"Content-Type": "audio/wav"} if method == "PUT" else {}
        status, raw = self.transport(method, url, headers | ({"x-ms-blob-type": "BlockBlob"} if blob else {}), body)
        if not 200 <= status < 300:
            raise Refused(f"storage HTTP {status}")
        return raw

    def run(self, name: str, records: list[dict], parameters: dict, read: Callable[[dict], bytes], wait: float = 900) -> list[dict]:
        """The batch's results, from wherever an earlier call got to."""
        identity = {"parameters": parameters, "inputs": records}
        state = self.store.get(name) or self._created(name, identity)
        if state["identity"] != identity:
            raise InvalidData("the saved job has other inputs or settings")
        if "results" not in state:
            if "job_id" not in state:
                raise Refused("it isn't known whether the job was created; look at the provider's list first")
            told = self._ended(self._started(name, read), state["job_id"], wait)
            found = self.collect(told, records, state["job_id"])
            state = self._saved(name, job_state=told["job_state"], results=found)
        return state["results"]

    def _saved(self, name: str, **more) -> dict:
        self.store[name] = self.store.get(name, {}) | more
        return self.store[name]

    def _created(self, name: str, identity: dict) -> dict:
        self._saved(name, identity=identity, creation_pending=True)
        made = self._call("POST", body={"job_parameters": identity["parameters"]})
        return self._saved(name, creation_pending=False, job_id=made["job_id"], storage=made["storage_container_type"])

    def _job(self, job_id: str, *path: str) -> str:
        return "/".join(["", quote(job_id, safe=""), *path])

    def _started(self, name: str, read: Callable[[dict], bytes]) -> dict:
        """The job's status once it runs; a new job is fed first."""
        state = self.store[name]
        told = self._call("GET", self._job(state["job_id"], "status"))
        if told["job_state"] != "Accepted":
            return told
        if not state.get("uploaded"):
            records = {r["upload_name"]: r for r in state["identity"]["inputs"]}
            links = self._call("POST", "/upload-files", {"job_id": state["job_id"], "files": [*records]})
            for file, record in records.items():
                self._store("PUT", links["upload_urls"][file]["file_url"], read(record), links["storage_container_type"].startswith("Azure"))
            self._saved(name, uploaded=True)
        return self._call("POST", self._job(state["job_id"], "start"))

    def _ended(self, told: dict, job_id: str, wait: float) -> dict:
        until = self.clock() + wait
        while told["job_state"] not in DONE:
            if self.clock() >= until:
                raise TimeoutError("the job still runs; run again to resume it")
            self.sleep(POLL)
            told = self._call("GET", self._job(job_id, "status"))
        return told

    def collect(self, told: dict, records: Iterable[dict], job_id: str) -> list[dict]:
        """Each record with its transcript, or with the reason why there is none."""
        details = told.get("job_details", [])
        named = [(x["file_name"], d) for d in details for x in d.get("inputs", [])]
        by_name = dict(named)
        if not len(by_name) == len(named) == len(details):
            raise InvalidData("inputs and outputs can't be matched")
        return [r | self._outcome(by_name.get(r["upload_name"]), job_id) for r in records]

    def _outcome(self, detail: dict | None, job_id: str) -> dict:
        """What one input came to; only a successful one with a single output is fetched."""
        outputs = [] if detail is None else [x["file_name"] for x in detail.get("outputs", [])]
        reason = "no answer for this file" if detail is None else None if detail.get("state") == "Success" else f"state {detail.get('state', 'unknown')}"
        if reason is None and len(outputs) != 1:
            reason = f"{len(outputs)} outputs"
        if reason:
            return {"status": "failed", "reason": reason}
        link = self._call("POST", "/download-files", {"job_id": job_id, "files": outputs})["download_urls"][outputs[0]]["file_url"]
        said = json.loads(self._store("GET", link))
        fields = {"transcript": said.get("transcript"), "request_id": said.get("request_id"), "detected_language": said.get("language_code")}
        if any(not isinstance(v, str) for k, v in fields.items() if v is not None or k == "transcript"):
            raise InvalidData("a result whose transcript or ids are no text")
        return {"status": "ok", **fields}


def _code(body: bytes) -> str:
    try:
        code = json.loads(body).get("error", {}).get("code", "")
    except (ValueError, AttributeError):
        return ""
    return code if isinstance(code, str) else ""


def cell(value: object) -> str:
    """A published number: two decimals; non-finite ones raise."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    if not math.isfinite(value):
        raise InvalidData("a non-finite metric can't be published")
    return f"{value:.2f}"
