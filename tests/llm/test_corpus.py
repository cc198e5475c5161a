import math
import pathlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bpe, credentials, ctw, decontaminate, jaccard, langid, packed, preferences, queries, shared, substrings, topk, toxicity

from . import fixture

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, width):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, share):
    sets = [shingles(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), least[find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("width, share", [(4, 85), (5, 80)])
def test_jaccard(spark, width, share):
    rows = fixture.documents()
    got = jaccard.join(fixture.table(spark, rows), width=width, share=share)
    assert {"score", "items"} <= set(got.columns)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, width, share)


def test_jaccard_chains_and_families(spark):
    """Families in which only some pairs link, so that hubs fail."""
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        base = fixture.words(rng, 90, 9999)
        for _ in range(25):
            v = list(base)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(v), None, None))
    got = jaccard.join(fixture.table(spark, rows))
    want = brute_components(rows, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert 4 < len({c for _, c in want.values()}) < 100


def test_signatures_meet(spark):
    """PartEnum: sets that link share a signature, however features fall."""
    rng = np.random.Generator(np.random.PCG64(2))
    for size in [*range(6, 40), 100, 300]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.integers(0, max(1, size * 15 // 200) + 1)
            b = np.sort(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            if not jaccard.linked(a, b, 85) or np.array_equal(a, b):
                continue
            s = object.__new__(jaccard.Sets)
            s.sets, s.sizes = [a, b], np.array([len(a), len(b)])
            s.at, s.flat, s.nodes = np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), np.array([1, 2], np.uint64)
            sig = jaccard.signatures(s, np.arange(2), 85)
            assert set(sig[sig[:, 1] == 1, 0].tolist()) & set(sig[sig[:, 1] == 2, 0].tolist())


def test_substrings(spark):
    rows = fixture.documents()
    texts = {r[0]: SPACED.findall(r[1] or "") for r in rows}
    starts = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    want = {}
    for k, w in texts.items():
        gone = {i + d for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for d in range(35)}
        want[k] = (" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))
    got = substrings.remove_repeats(fixture.table(spark, rows))
    assert {r["doc_id"]: (r["kept"], r["n_words"], r["n_removed"]) for r in got.collect()} == want
    assert any(x[2] for x in want.values())


@pytest.mark.parametrize("size", [1, 2, 5, 8, 13, 60])
def test_substrings_other_sizes(spark, size):
    rng = random.Random(size)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(0, 90))), None, None) for i in range(8)]
    texts = {r[0]: r[1].split() for r in rows}
    starts = Counter(tuple(w[i : i + size]) for w in texts.values() for i in range(len(w) - size + 1))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(fixture.table(spark, rows), size=size).collect()}
    assert got == {k: len({i + d for i in range(len(w) - size + 1) if starts[tuple(w[i : i + size])] > 1 for d in range(size)}) for k, w in texts.items()}


def test_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_hits(rows, tests, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for k, text, *_ in rows:
        w, hit, names = word.findall(lower(text)), set(), set()
        for name, t in tests:
            v = word.findall(lower(t))
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        names |= {str(name)} if name is not None else set()
        out[k] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("budget", [decontaminate.BLOCK_BYTES, 150])
def test_decontaminate(spark, budget):
    rng = random.Random(9)
    rows = fixture.documents(2)
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    tests = [(i, " ".join(t.upper().split()[5:28])) for i, t in enumerate(long[:4])]
    tests += [(10, "one"), (11, "a b c"), (12, None), (None, long[5]), (13, ""), (14, " ".join(fixture.words(rng, 30))), (2, long[6]), (15, "ONE, two!")]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.match(fixture.table(spark, rows), bench, budget=budget).collect()
    want = brute_hits(rows, tests, 10)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert all(sum(m["words"] for m in r["matches"]) == r["n_hit"] for r in got)
    kept = decontaminate.decontaminate(fixture.table(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "score", "items"] and {r["doc_id"] for r in kept.collect()} == {k for k, x in want.items() if not x[1]}
    none = decontaminate.match(fixture.table(spark, rows), bench.limit(0)).collect()
    assert {r["n_hit"] for r in none} == {0} and len(none) == len(rows)


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x300), 0x1C, 0x85, 10, 32, 0x1F600])) for _ in range(rng.randrange(50))) for _ in range(200)]
    rows = fixture.documents() + [(1000 + i, t, None, None) for i, t in enumerate([*odd, "x<|endoftext|> y", "ab" * 4000])]
    for r in bpe.encode_decode(fixture.table(spark, rows), queries.vocabulary()).collect():
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == known.decode(ids, skip_special_tokens=False)


def test_ctw_base_and_sum(spark):
    rows = fixture.documents()
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = {r["doc_id"]: r for r in ctw.score(fixture.table(spark, rows), learn, out="score").collect()}
    tok = {r[0]: [*SPACED.findall(lower(r[1])), "\n"] for r in rows}
    c = Counter(w for k, ws in tok.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    N, V = sum(c.values()), len(c)
    for k, ws in tok.items():
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), N)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in ws))
    stream = lambda k: "".join(f"{w} " for w in tok[k][:-1])[:-1] + "\n" if len(tok[k]) > 1 else "\n"
    want = brute_ctw([stream(k).encode() for k in tok if zlib.crc32(str(k).encode()) % 7 != 2], {k: stream(k).encode() for k in list(tok)[:12]})
    for k, s in want.items():
        assert got[k]["score"] == pytest.approx(s, rel=1e-4)


def brute_ctw(texts, asked, depth=ctw.DEPTH):
    """The tree as dictionaries: (bits before, context) -> counts."""
    n = {}
    for t in texts:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            for b in range(8):
                bit, prefix = data[i] >> (7 - b) & 1, (b, data[i] >> (8 - b))
                for d in range(depth + 1):
                    n.setdefault((prefix, data[i - d : i]), [0, 0])[bit] += 1
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in n.items()}
    below, weighted = {}, {}
    for prefix, context in sorted(n, key=lambda k: -len(k[1])):
        k = prefix, context
        weighted[k] = own[k] if len(context) == depth else math.log(0.5) + np.logaddexp(own[k], below[k])
        if context:
            below[prefix, context[1:]] = below.get((prefix, context[1:]), 0) + weighted[k]
    out = {}
    for name, t in asked.items():
        data, total = b"\n" * depth + t, 0.0
        for i in range(depth, len(data)):
            for b in range(8):
                bit, prefix = data[i] >> (7 - b) & 1, (b, data[i] >> (8 - b))
                p = None
                for d in range(depth, -1, -1):
                    k = prefix, data[i - d : i]
                    if k in n:
                        kt = (n[k][bit] + 0.5) / (sum(n[k]) + 1)
                        w = math.exp(math.log(0.5) + own[k] - weighted[k])
                        p = kt if p is None else w * kt + (1 - w) * p
                total += math.log10(0.5 if p is None else p)
        out[name] = total
    return out


def test_ctw_without_training(spark):
    got = ctw.score(fixture.table(spark, [(1, "ab", None, None), (2, None, None, None)]), F.lit(False)).collect()
    assert {r["doc_id"]: round(r["score"] / math.log10(1 / 256), 6) for r in got} == {1: 3, 2: 1}


def test_topk(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, (rng.normal(size=6) * rng.exponential()).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (305, [0.0] * 6)]
    rows += [(400 + i, rows[7][1]) for i in range(40)]  # copies and ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = {k: [math.floor(1024 * x) for x in v] for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (k for k in fine if k % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], v)), k) for k, v in fine.items() if k != q)[:10]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    got = topk.search(df, F.col("vec_id") % 20 == 0, bucket=32, query_block=4)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.search(df.limit(0), F.lit(True)).isEmpty()
    few = topk.search(df.filter("vec_id < 3"), F.lit(True)).count()
    assert few == 6


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        'x password = "hunter22" y', "Token: abc", "TOKEN:abcdef", "api_key='k.e-y_1/2' apikey=zzzzzz", "sécret", f"é {key} and deadbeef" + "0" * 20, "AKIA" + "B" * 15,
        f"id {key} key Zx9Zx9Zx9Zx9Zx9Zx9 at https://db.example/x", "key Zx9Zx9Zx9Zx9Zx9Zx9 at https://db.example/x", f"{key} " + "zz " * 200 + " Zx9Zx9Zx9Zx9Zx9Zx9", "", None, "secret=secret=abcdef",
    ]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    pattern = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in credentials.find_secrets(fixture.table(spark, rows)).collect()}
    for i, t in enumerate(texts):
        want = sorted(((k, m.start(), m.end()) for k, (p, ok) in pattern.items() for m in p.finditer(t or "") if ok(m)), key=lambda x: (x[1], list(pattern).index(x[0])))
        assert [s for s in got[i] if s[0] in pattern] == want
    assert {s[0] for s in got[7]} == {"access", "part_secret", "part_endpoint"}
    assert got[8] == [] and {s[0] for s in got[9]} == {"access"}
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(fixture.table(spark, rows)).collect()}
    assert clean[0] == "x [ASSIGN]\" y" and clean[4] == "sécret" and clean[11] is None and "Zx9" not in clean[7]


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "<|x|>"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (6, 0, "user", None), (7, None, None, "z"), (None, 0, "user", "q"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["part"], r["turn"]): (r["rendered"], r["loss"]) for r in preferences.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert got == {
        (0, "prompt", 0): ("<|user|>\nhi<|end|>\n", False), (0, "chosen", 1): ("<|assistant|>\ngood<|end|>\n", True), (0, "chosen", 2): ("<|user|>\n< |x|><|end|>\n", False),
        (0, "rejected", 1): ("<|assistant|>\nbad<|end|>\n", True), (1, "prompt", 0): ("<|user|>\nsame<|end|>\n", False),
        (3, "chosen", 0): ("<|user|>\n<|end|>\n", False), (3, "rejected", preferences.LAST): ("<|unknown|>\nz<|end|>\n", False),
    }


def test_language_accuracy_and_rejection(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op10_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    model = langid.fit(docs, F.lit(True))
    odd = {r["doc_id"]: r for r in langid.identify(fixture.table(spark), model).collect()}
    texts = {r[0]: r[1] for r in fixture.documents()}
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[k] or "")) for k, r in odd.items())
    assert langid.identify(fixture.table(spark, []), model).isEmpty() and langid.fit(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(fixture.table(spark), None).collect()} == {"und"}


def test_toxicity(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    hit = held[held.toxic == 1].predicted.mean()
    assert hit > 0.7 and held[held.toxic == 0].predicted.mean() < 0.01 and got.score.between(0, 1).all()
    toxic, clean = held[held.toxic == 1].score.values, held[held.toxic == 0].score.values
    assert np.mean([(x > clean).mean() + (x == clean).mean() / 2 for x in toxic]) > 0.95 and (toxic >= np.quantile(clean, 0.95)).mean() > 0.9
    model = toxicity.train(*toxicity.sample(docs, labels, F.lit(True), rows_per_label=400))
    text = "Anhe the stupid loser reth. Thene ed."
    row = toxicity.score(fixture.table(spark, [(1, text, None, None), (2, None, None, None), (3, "", None, None)]), model).collect()
    by = {r["doc_id"]: r for r in row}
    assert by[1]["score"] > by[2]["score"] == by[3]["score"] and by[1]["offending"][0]["start"] == 0
    assert toxicity.train([], []) is None and toxicity.score(fixture.table(spark), None).count() == len(fixture.documents())


def test_empty_tables(spark):
    none = fixture.table(spark, [])
    assert jaccard.join(none).isEmpty() and substrings.remove_repeats(none).isEmpty() and ctw.score(none, F.lit(True)).isEmpty()
    assert bpe.encode_decode(none, queries.vocabulary()).isEmpty() and credentials.find_secrets(none).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").collect()
    model = langid.fit(queries.table(spark, "/root/testdata/sf0.001", "documents"), queries.remainder(4) != 2)
    rejected = {r["doc_id"] for r in langid.identify(queries.table(spark, "/root/testdata/sf0.001", "documents"), model).filter("rejected").collect()}
    rows = [tuple(r) for r in docs if r["doc_id"] not in rejected]
    comp = brute_components(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    bench = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    hits = brute_hits(rows, bench, 10)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows if not hits[r[0]][1]}
    assert out.filter("NOT intact").isEmpty()
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(queries.vocabulary())
    masked = credentials.redact(queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert all(r["ids"] == known.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in out.collect())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_paired_records(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 2, "assistant", "good"), (0, 1, "user", "and"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 1, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "x"), *[(5, i, "user", "y") for i in range(9)],
    ]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    rows = preferences.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    records, rest = preferences.paired(rows, most=8)
    got = {r["pair_id"]: (r["prompt"], [tuple(x) for x in r["chosen"]], [tuple(x) for x in r["rejected"]]) for r in records.collect()}
    user, bot = "<|user|>\n{}<|end|>\n", "<|assistant|>\n{}<|end|>\n"
    assert got == {
        0: (user.format("hi"), [(user.format("and"), False), (bot.format("good"), True)], [(bot.format("bad"), True)] * 2),
        1: (user.format("same"), [], []),
    }
    assert {r["pair_id"] for r in rest.collect()} == {2} and rest.count() == 10
    assert preferences.format_preferences(df.limit(0), F.col("conv_id"), F.lit(True)).isEmpty()


def test_pipeline_stages_with_hard_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(r[0] if r[0] != 5 else None, r[1], "en" if r[0] % 2 else None, None if r[0] % 3 else "s", None, "extra") for r in fixture.documents(4)]
    rows += [rows[7], rows[7], (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert number == 4 or out.columns == docs.columns
            assert out.count() <= given.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("intact").count() > 30


def test_language_rejection_of_unlearned_text(spark):
    """Known and bilingual texts stay; texts of a language that was left out, of others, and letter junk go."""
    rng = random.Random(6)
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    rows = sorted(((r["doc_id"], r["text"], r["lang"]) for r in docs.filter("length(text) > 200").collect()), key=lambda r: r[0])
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    of = lambda some, lang, n: [t[:1500] for _, t, l in some if l == lang][:n]
    others = ("en", "es", "fr")
    model = langid.train([t for l in others for t in of(learned, l, 300)], [l for l in others for _ in of(learned, l, 300)])
    known = [t for l in others for t in of(held, l, 100)]
    pairs = [rng.sample(others, 2) for _ in range(200)]
    both = [rng.choice(of(held, a, 100))[:300] + "\n" + rng.choice(of(held, b, 100))[:300] for a, b in pairs]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(100)) for _ in range(200)]
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."]
    sets = {"known": known, "both": both, "left out": of(held, "de", 100), "junk": junk, "foreign": foreign}
    table = fixture.table(spark, [(i, t, name, None) for i, (name, t) in enumerate((n, t) for n, ts in sets.items() for t in ts)])
    share = {r["score"]: r["r"] for r in langid.identify(table, model, score="chance").groupBy("score").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()}
    assert share["known"] < 0.02 and share["both"] < 0.02
    assert share["left out"] > 0.95 and share["junk"] > 0.95 and share["foreign"] == 1


def test_one_row_of_each_component_stays(spark):
    """Rows that repeat an id or have none are copies as well."""
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (" ".join(fixture.words(rng, 60)) for _ in range(4))
    rows = [(3, a), (3, a), (3, a + " more"), (7, a), (None, b), (None, b), (None, b + " more"), (None, c), (9, c), (9, c), (5, d), (5, ""), (5, ""), (None, ""), (None, ""), (None, None)]
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_near_copies(spark, table, "")
    assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
    got = Counter((r["doc_id"], (r["text"] or "")[:20]) for r in out.collect())
    assert got == Counter([(3, a[:20]), (None, b[:20]), (9, c[:20]), (5, d[:20]), (5, ""), (None, ""), (None, "")])


def test_secret_parts_link_over_scope_edges(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    token, url = "Zx9" * 200, "https://db.example/x"
    nested = "token=" + "0a" * 15 + "zy" * 300  # the assignment reaches past the scope
    texts = [f"{key} {token}", f"{key} " + "z " * 140 + token, f"{key} {'é ' * 140}Zx9Zx9Zx9Zx9Zx9Zx9", f"{key} {url} {nested}", f"aws_access_key_id: ASIAABCDEFGH12345678 Zx9Zx9Zx9Zx9Zx9Zx9 {url}",
             "client_id = shop-4711 key Zx9Zx9Zx9Zx9Zx9Zx9", "client_id = shop-4711 alone", f"{key} {'é ' * 160}Zx9Zx9Zx9Zx9Zx9Zx9", "Asia and the key to apps"]
    got = credentials.find_secrets(fixture.table(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in got}
    assert kinds[0] == kinds[1] == kinds[2] == {"access", "part_secret"}
    assert kinds[3] == {"access", "assign", "hex", "part_endpoint"} and kinds[4] == {"part_access", "part_secret", "part_endpoint"}
    assert kinds[5] == {"part_access", "part_secret"} and kinds[6] == kinds[8] == set() and kinds[7] == {"access"}
    # a long assignment past the first scope doesn't hide a hex run that is nested in it
    assert credentials.within([(0, 10), (30, 40)], [(5, 90), (8, 9), (32, 35), (50, 60)]) == [((0, 10), (5, 90)), ((30, 40), (5, 90)), ((0, 10), (8, 9)), ((30, 40), (32, 35))]


@pytest.mark.parametrize("budget", [decontaminate.BLOCK_BYTES, 60])
def test_longest_verbatim_matches(spark, budget):
    """Each with its item and places, where windows of two items and of two places of one item touch."""
    a, b, c = ([f"{x}{i}" for i in range(25)] for x in "abc")
    tests = [(1, " ".join(a)), (2, " ".join(b[:12] + c[:12])), (3, "q r"), (None, " ".join(a[3:14]))]
    texts = [a[5:20] + b[:12], c[:11] + b[1:12] + ["x"] + a[:9], ["q", "r", "q", "r"], b + c]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.match(fixture.table(spark, [(i, " ".join(t), None, None) for i, t in enumerate(texts)]), bench, budget=budget).collect()
    words = [(str(k) if k is not None else None, t.split()) for k, t in tests]
    for r in got:
        w, want = texts[r["doc_id"]], []
        for name, v in words:
            for i in range(len(v)):
                for j in range(len(w)):
                    if i and j and v[i - 1] == w[j - 1]:
                        continue
                    n = next((k for k in range(len(v) - i + 1) if i + k == len(v) or j + k == len(w) or v[i + k] != w[j + k]))
                    if n >= min(10, len(v)):
                        want.append((name, i, j, n))
        assert sorted(map(tuple, r["verbatim"]), key=repr) == sorted(want, key=repr) and want


def test_without_labelled_rows_texts_stay(spark):
    import corpus_pipeline

    rows = [(i, t, None, "s", 1) for i, t in enumerate(["one two three", "vier", "...", "", None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, table, "").collect()} == {0, 1}


def test_every_language_is_learned_or_an_error_raised(spark):
    rng = random.Random(3)
    letters = {f"l{k:02}": [f"{rng.choice('bcdfgh')}{chr(0x100 + 4 * k + j)}{rng.choice('aeiou')}" for j in range(4)] for k in range(30)}
    rows = [(len(letters) * i + k, " ".join(rng.choices(own, k=30)), l, None) for i in range(20) for k, (l, own) in enumerate(letters.items())]
    table = fixture.table(spark, rows).withColumnRenamed("score", "lang")
    with pytest.raises(ValueError, match="more than 29"):
        langid.fit(table, F.lit(True), max_languages=29)
    few = Counter(l for _, l in langid.sample(table, F.lit(True), max_rows=300))
    assert len(few) == 30 and sum(few.values()) < 450
    model = langid.fit(table, F.lit(True))
    assert len(model.languages) == 30 and model.table.shape[1] == 16
    got = langid.identify(table, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_ctw_code_length(spark):
    rows = fixture.documents()
    got = ctw.score(fixture.table(spark, rows), F.lit(True)).collect()
    for r in got:
        words = SPACED.findall(r["text"] or "")
        assert r["n_bytes"] == max(1, sum(len(w.encode()) + 1 for w in words))
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"])
    none = ctw.score(fixture.table(spark, [(1, "ab", None, None)]), F.lit(False)).first()
    assert none["n_bytes"] == 3 and none["bits_per_byte"] == pytest.approx(8)


def test_jaccard_family_of_several_blocks(spark):
    """More nodes at a hub than a block holds, in components that only some of their pairs join."""
    rng = random.Random(11)
    base, rows = fixture.words(rng, 60, 9999), []
    for i in range(700):
        v = list(base)
        for _ in range(rng.randrange(0, 6)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(v), None, None))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(fixture.table(spark, rows)).collect()}
    want = brute_components(rows, 4, 85)
    assert got == want and len({c for _, c in want.values()}) > 5


def test_packed_pieces():
    rng = np.random.Generator(np.random.PCG64(4))
    keys = [packed.ordered(rng.integers(0, 1 << 64, (n, 2), np.uint64)) for n in (0, 1, 50, 300)]
    column = pa.array([k.tobytes() for k in keys], pa.binary()).slice(1)
    rows = packed.views(column, 2)
    assert [len(r) for r in rows] == [1, 50, 300] and np.array_equal(rows[2], keys[3])
    for number in (1, 7):
        assert np.array_equal(np.concatenate([*packed.in_pieces(rows, number)]), packed.ordered(np.concatenate(keys)))
    assert not [*packed.in_pieces([], 3)]


def test_bpe_store_and_settings():
    import json

    with open(queries.vocabulary(), encoding="utf-8") as f:
        told = json.load(f)
    codec = bpe.Codec(json.dumps(told))
    texts = fixture.documents(3)
    whole, ends = codec.encode_all([t or "" for _, t, *_ in texts], bpe.Store(codec.added))
    small = bpe.Store(codec.added, most=2000)  # starts anew again and again
    parts = [codec.encode_all([t or ""], small)[0] for _, t, *_ in texts]
    assert all(np.array_equal(x, whole[a:b]) for x, a, b in zip(parts, ends[:-1], ends[1:], strict=True)) and small.used <= 2000 and small.keys() >= codec.added.keys()
    long = "word, 12 " * (bpe.LONG // 6)  # is cut step by step
    ids, _ = codec.encode_all([long], bpe.Store(codec.added))
    assert codec.decode(ids) == long
    for broken in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"added_tokens": [{"id": 50256, "content": "<|endoftext|>", "lstrip": True}]}):
        with pytest.raises(ValueError, match=next(iter(broken))):
            bpe.Codec(json.dumps(told | broken))


def test_conflicting_labels_and_whole_documents(spark):
    """One label an id, the toxic one; long documents are learned from; the sample is the same each time."""
    docs = spark.createDataFrame([(i, f"w{i} bad " * (3000 if i == 3 else 5)) for i in range(20)] + [(7, "again"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (4, 1), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    bags, y = toxicity.sample(docs, labels, F.lit(True))
    assert len(bags) == 21 and sum(y) == 12 and max(len(w) for w, _ in bags) == 6000
    again, _ = toxicity.sample(docs.repartition(5), labels.repartition(4), F.lit(True))
    assert all(np.array_equal(a[0], b[0]) for a, b in zip(bags, again, strict=True))
    few, _ = toxicity.sample(docs, labels, F.lit(True), max_chars=40)
    assert 2 <= len(few) < 21
    assert toxicity.sample(docs.limit(0), labels, F.lit(True)) == ([], [])


def test_repeated_rows_and_clashing_columns(spark):
    """Repeated rows stay, columns with the names of new ones are replaced, others are kept."""
    rows = [(1, "one two password=abcdef12 three", "x", "x", "x", "x", 9), (1, "one two password=abcdef12 three", "x", "x", "x", "x", 9), (None, None, None, None, None, None, None), (2, "", "x", "x", "x", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, spans string, score string, `kept` string, n_words int").repartition(3)
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs, F.lit(True), rows_per_language=20)
    made = {
        "ids": bpe.encode_decode(df, queries.vocabulary()), "spans": credentials.find_secrets(df), "score": ctw.score(df, F.lit(True)),
        "kept": substrings.remove_repeats(df, size=2), "n_words": decontaminate.match(df, spark.createDataFrame([(1, "two password")], "item_id long, text string")),
    }
    made |= {"lang": langid.identify(df, model), "tox": toxicity.score(df, None), "n_shingles": jaccard.join(df)}
    for name, out in made.items():
        got = out.collect()
        assert len(got) == 4 and sum(r["doc_id"] == 1 for r in got) == 2 and {"doc_id", "text"} <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        same = [r for r in got if r["doc_id"] == 1]
        assert same[0] == same[1]
    assert {r["n_removed"] for r in made["kept"].collect() if r["doc_id"] == 1} == {4}
    assert {r["n_hit"] for r in made["n_words"].collect() if r["doc_id"] == 1} == {2}


@pytest.mark.parametrize("most", [8, 2048])
def test_jaccard_texts_go_only_where_marks_allow_a_link(spark, monkeypatch, most):
    """Of a hub's many nodes that share next to nothing, two that link and are not the hub are found, and only their texts are sent."""
    monkeypatch.setattr(jaccard, "BLOCK_MARKED", most)
    rng = random.Random(31)
    texts = [fixture.words(rng, 300, 10**6) for _ in range(40)]
    texts = [" ".join(x) for x in [*texts, texts[7][:-5]]]
    s = jaccard.Sets(pa.array(texts, pa.large_string()), 4)
    nodes = s.nodes.astype(np.int64).tolist()
    table = spark.createDataFrame([(n, t, int(z), bytearray(jaccard.mark(x))) for n, t, z, x in zip(nodes, texts, s.sizes, s.sets, strict=True)], "node long, t string, size long, mark binary")
    stars = spark.createDataFrame([(nodes[0], n) for n in nodes[1:]], "a long, b long")
    told = spark.createDataFrame([(nodes[0], n, n, n != nodes[0], int(z)) for n, z in zip(nodes, s.sizes, strict=True)], "hub long, node long, component long, out boolean, size long")
    two = {nodes[7], nodes[40]}
    assert {r["node"] for r in jaccard._may_link(told, table, 85).collect()} == two
    comp = table.select("node", F.col("node").alias("component"))
    assert {frozenset([r["a"], r["b"]]) for r in jaccard._outside(stars, comp, table, 4, 85).collect()} == {frozenset(two)}


def test_kept_leaves_no_shuffle_files(spark):
    """Whether or not the driver collects its garbage; the session's setting stays as it was."""

    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {str(f) for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(shared._CLEANUP, None)
    table = shared.kept(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(40):  # they are deleted in the background
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before and spark.conf.get(shared._CLEANUP, None) == setting
    assert sum(r["count"] for r in table.collect()) == 20_000
    path = pathlib.Path(table._kept_at.removeprefix("file:"))
    assert path.exists()
    shared.let_go(table)
    assert not path.exists() and table._kept_at not in shared._kept
