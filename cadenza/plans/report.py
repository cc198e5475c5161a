"""The published report, rendered on the driver from a few aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cadenza.operators.validate import InvalidData
from cadenza.sources.clients import cell
from cadenza.sources.sinks import write_text

OVERALL = (
    ("Corpus WER %", "corpus_wer_percent"),
    ("Corpus CER %", "corpus_cer_percent"),
    ("Sentence-average WER %", "mean_sentence_wer_percent"),
    ("Sentence-average CER %", "mean_sentence_cer_percent"),
    ("DNSMOS P.808", "p808"),
    ("DNSMOS OVRL", "ovrl"),
)


def _values(df: DataFrame, kind: str, name: str) -> dict:
    return {(r["system"], r["slice_value"]): r[name] for r in df.filter(f"slice_kind = '{kind}'").select("system", "slice_value", name).collect()}


def _table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows), ""]


def render(title: str, systems: Sequence[str], dataset_hash: str, rates: DataFrame, quality: DataFrame, consistency: tuple[DataFrame, DataFrame] | None = None) -> str:
    """Markdown; raises if a number is missing or not finite. ``consistency``: (per language, per system)."""

    def number(values: dict, key: tuple) -> str:
        if values.get(key) is None:
            raise InvalidData(f"no value for {key}")
        return cell(float(values[key]))

    langs = sorted({v for (_, v) in _values(rates, "lang", "clips")})
    clips = _values(rates, "lang", "clips")
    out = [f"# {title}", "", f"Dataset SHA-256: `{dataset_hash}`.", "", "## Overall", ""]
    rows = [[label, *[number(_values(rates if name.endswith("percent") else quality, "matched_only", name), (s, None)) for s in systems]] for label, name in OVERALL]
    if consistency:
        macro = {(r["system"], None): r["macro_mean_across_languages"] for r in consistency[1].collect()}
        rows.append(["Voice consistency", *[number(macro, (s, None)) for s in systems]])
    out += _table(["Metric", *systems], rows)
    sections = [("Corpus WER % by language (lower is better)", _values(rates, "lang", "corpus_wer_percent")), ("DNSMOS P.808 by language (higher is better)", _values(quality, "lang", "p808"))]
    if consistency:
        sections.append(("Voice consistency by language (higher is better)", {(r["system"], r["lang"]): r["mean"] for r in consistency[0].collect()}))
    for name, values in sections:
        body = [[lang, str(clips.get((systems[0], lang), 0)), *[number(values, (s, lang)) for s in systems]] for lang in langs]
        out += [f"## {name}", "", *_table(["Language", "Clips a system", *systems], body)]
    out += ["## Notes", "", "- All comparisons are over the prompts that every system has, with equal audio hashes.", "- Error rates measure agreement of a recognizer with the written reference.", "- Audio quality is a proxy, no listening test.", ""]
    return "\n".join(out)


def publish(path: str, text: str) -> None:
    write_text(path, text)
