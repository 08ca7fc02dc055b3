"""Near-duplicates, substring dedup, mixing and the pipeline against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fluxgrid.llm import mixing, simhash, substring_dedup
from fluxgrid.llm import queries as Q
from tests.llm.test_text import plain_masked

WORD = rb"[^\x20\x09-\x0D]+"
DATA = "/root/testdata/sf0.001"


def plain_print(text):
    w = re.findall(WORD, (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    """{node: least node} over all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in parent}


def test_near_duplicates(odd, odd_rows):
    short = [(d, t) for d, t in odd_rows if len(t or "") < 100_000]
    found = simhash.near_duplicates(odd.where("coalesce(length(text), 0) < 100000")).select("doc_id", simhash.fingerprint_hex().alias("p"), "component_id").collect()
    prints = {(d, t): plain_print(t) for d, t in short}
    roots = plain_components(prints.values())
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[roots[p]] = min(least.get(roots[p], d), d)
    want = sorted(((d or -1), f"{prints[d, t]:016x}", least.get(roots[prints[d, t]])) for d, t in short)
    assert sorted(((r.doc_id or -1), r.p, r.component_id) for r in found) == want


def test_long_lists_and_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [centre ^ np.uint64(sum(1 << int(k) for k in rng.choice(24, rng.integers(0, 4), replace=False))) for _ in range(300)]
    prints = np.unique(np.array([*near, *rng.integers(0, 1 << 63, 200, dtype=np.uint64)], np.uint64))
    rows = [b for x in simhash.listed([pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], ["fp"])]) for b in zip(x.column("list").to_pylist(), x.column("fp").to_pylist())]
    rows.sort()
    links = set()
    for size in (37, 10_000_000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in (0, 1)], ["list", "fp"]) for i in range(0, len(rows), size)]
        links = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for x in simhash.linked(batches) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist()) if b is not None}
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {p: find(p) for p in parent} == plain_components(parent)


def test_lists_too_long_for_a_task(spark, monkeypatch):
    """Blocks of long lists, over many batches: the same components as all pairs."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LONG", 50)
    monkeypatch.setattr(simhash, "LIST_BLOCK", 20)
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(k) for k in rng.choice(24, rng.integers(0, 9), replace=False)) for _ in range(400)}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    rows = sorted(zip(*(np.concatenate([x.column(c).to_numpy() for x in simhash.listed([pa.RecordBatch.from_arrays([pa.array(sorted(prints), pa.int64())], ["fp"])])]).tolist() for c in ("list", "fp"))))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 33]], pa.int64()) for k in (0, 1)], ["list", "fp"]) for i in range(0, len(rows), 33)]
    links, blocks = [], {}
    for x in simhash.linked(batches):
        for a, b, key, block in zip(*(x.column(c).to_pylist() for c in simhash.LINK_NAMES)):
            if b is None:
                blocks.setdefault(key, {}).setdefault(block, []).append(a)
            else:
                links.append((a, b))
    assert blocks and all(len(v) <= 20 for lists in blocks.values() for v in lists.values())
    sizes = {}
    for r in rows:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    assert {k: sum(map(len, v.values())) for k, v in blocks.items()} == {k: n for k, n in sizes.items() if n > 50}
    pairs = [(hash((k, i, j)), f) for k, v in blocks.items() for i in v for j in v if i < j for f in v[i] + v[j]]
    pairs.sort()
    split = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in pairs[i : i + 70]], pa.int64()) for k in (0, 1)], ["list", "fp"]) for i in range(0, len(pairs), 70)]
    links += [p for x in simhash.spanned(split) for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {p: find(p) for p in parent} == plain_components(parent)


def test_long_lists_in_the_whole_plan(spark):
    rng = np.random.default_rng(2)
    prints = sorted({0x0123456789ABCDEF ^ sum(1 << int(k) for k in rng.choice(22, rng.integers(0, 9), replace=False)) for _ in range(18000)})
    found = simhash.rooted(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    root = {r.fp: r.root for r in found}
    array = np.array(prints, np.uint64)
    assert len(prints) > simhash.LONG
    for p in prints:
        assert {root[int(q)] for q in array[np.bitwise_count(array ^ np.uint64(p)) <= 4]} == {root[p]}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def plain_removed(rows):
    """{(doc_id, text): (n_words, n_removed, sha)}; null ids lose nothing."""
    least, words = {}, {}
    for d, t in rows:
        w = words[d, t] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w) - 49) if d is not None else ():
            k = tuple(w[i : i + 50])
            least[k] = min(least.get(k, d), d)
    out = {}
    for (d, t), w in words.items():
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if least[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(odd, odd_rows):
    found = sorted(((r.doc_id or -1), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(odd).collect())
    want = plain_removed(odd_rows)
    assert found == sorted(((d or -1), *want[d, t]) for d, t in odd_rows)


def test_substring_dedup_of_overlapping_passages(spark):
    """Windows that a third document holds across two others, periodic texts, equal ids with different texts."""
    w = [f"w{k}" for k in range(200)]
    rows = [
        (1, " ".join(w[:120])), (2, " ".join(w[80:200])), (3, " ".join(w)), (4, " ".join(["a", "b", "c"] * 60)), (5, " ".join(["b", "c", "a"] * 50)),
        (6, " ".join(w[10:59])), (7, " ".join(["q", *w[10:60], "r"])), (7, " ".join(["s", *w[100:170]])), (8, " ".join(["w0"] * 70)), (9, " ".join(["w0"] * 60)),
    ]
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = plain_removed(rows)
    assert found == sorted((d, *want[d, t]) for d, t in rows)


def test_substring_dedup_of_text_ids(spark, odd_rows):
    rows = [(None if d is None else f"id-{d:03}", t) for d, t in odd_rows]
    found = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    want = plain_removed(rows)
    assert found == sorted((str(d), *want[d, t]) for d, t in rows)


def test_many_automata_and_salts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_PHRASES", 2)
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "MEMO_BYTES", 600)
    test_substring_dedup_of_overlapping_passages(spark)


def test_mix_reaches_its_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "big" if k % 3 else f"s{k % 15}") for k in range(6000)]
    docs = spark.createDataFrame([*rows, (None, None, None), (7000, "", "blank"), (1, "w w", "big")], "doc_id long, text string, source string")
    for mix in (mixing.Mix(0.97, 100.0, None, 100), mixing.Mix(1.0, 2.0, None, 100), mixing.Mix(0.97, 100.0, 40000.0, 100), mixing.Mix(1.0, 1.5, None, 100, 0.9)):
        drawn = mixing.drawn(docs, mix).select("doc.doc_id", "doc.source", "src", F.size(F.filter(F.split(F.coalesce("doc.text", F.lit("")), " "), lambda w: w != "")).alias("n"), "tokens" if False else "n_copies", "weight", "epochs", "exponent").collect()
        assert len(drawn) == 6003
        real = [r for r in drawn if r.weight is not None]
        weight = {r.src: r.weight for r in real}
        assert abs(sum(weight.values()) - 1) < 1e-9
        entropy = -sum(w * np.log(w) for w in weight.values()) / np.log(len(weight))
        most = max(r.epochs for r in real)
        assert most <= mix.repeats + 1e-6
        assert entropy >= mix.entropy - 1e-6 or abs(most - mix.repeats) < 1e-3
        for src in weight:
            own = [r for r in real if r.src == src]
            want = own[0].epochs * sum(r.n for r in own)
            got = sum(r.n * r.n_copies for r in own)
            assert want - 14 - 1 <= got <= want + 1e-6, (src, want, got)
        if mix.budget is None and mix.share is None:
            assert min(r.n_copies for r in drawn) >= 1
    assert mixing.mix_rows(docs, mixing.Mix(block=100)).columns == docs.columns


def test_query_mixes_sources_whole(spark, tmp_path):
    """The query leaves no document out and repeats small sources until weights are even or four epochs are reached."""
    rows = [(k, "w " * 50, s) for k, s in enumerate(["small"] * 20 + ["middle"] * 60 + ["large"] * 600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for where, repeats in ((DATA, None), (str(tmp_path), {"small": 4.0, "large": 1.0})):
        drawn = Q.op2_mixing(spark, where).collect()
        assert len(drawn) == spark.read.parquet(f"{where}/documents.parquet").count()
        assert min(r.n_copies for r in drawn) == 1 and sum(r.n_copies > 1 for r in drawn) * 10 > len(drawn)
        epochs, weight = {r.source: r.epochs for r in drawn}, {r.source: r.weight for r in drawn}
        entropy = -sum(w * np.log(w) for w in weight.values()) / np.log(len(weight))
        if repeats is None:
            assert entropy >= 0.9999 - 1e-5 and 1.5 < max(epochs.values()) <= 4
        else:
            assert entropy < 0.99 and {s: round(epochs[s], 4) for s in repeats} == repeats and 2 < epochs["middle"] < 4


def test_one_of_each_keeps_every_different_text(spark):
    """Repeated and null ids: one row of each component, the same one in any order of rows."""
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    three = spark.createDataFrame([(3, texts[0]), (5, texts[0]), (5, texts[1])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(three).collect())) == [(3, texts[0]), (5, texts[1])]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1], "y"), (2, texts[1], "x"), (None, texts[2], "x"), (None, texts[2], "x"),
            (None, texts[3], "x"), (None, texts[0], "x"), (3, texts[4], "x"), (3, texts[5], "x"), (2, texts[5], "x"), (4, None, "x"), (4, "", "x")]
    kept = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        kept.append(sorted(map(tuple, simhash.one_of_each(frame).collect()), key=str))
    assert kept[0] == kept[1]
    assert sorted(str((d, t)) for d, t, _ in kept[0]) == sorted(
        map(str, [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (2, texts[5]), (4, None)])
    )


def test_empty_tables(spark, nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert substring_dedup.removed(nothing).count() == 0
    assert mixing.mix_rows(nothing).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    out = docs
    kept, texts, drawn = [], {}, {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = corpus_pipeline.stored(stage(spark, out, DATA), f"test-{k}")
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        assert out.columns == names or k == 4
        if k == 2:  # every text has its pseudonyms, and n_chars follows
            old = {r.doc_id: r.text for r in before.collect()}
            for r in out.collect():
                assert r.text == plain_masked(old[r.doc_id] or "", Q.TRIAL_KEY)[0] and r.n_chars == len(r.text)
            texts = {r.doc_id: r.text for r in out.collect()}
        if k == 3:  # as often as the weights of the sources ask for, with all columns
            drawn = Counter(r.doc_id for r in out.collect())
            want = {r.doc_id: r.n_copies for r in mixing.drawn(before, Q.MIX).select("doc.doc_id", "n_copies").collect()}
            assert drawn == Counter({d: n for d, n in want.items() if n})
            by_source = Counter()
            for r in out.collect():
                by_source[r.source] += len(re.findall(WORD, r.text.encode()))
            shares = np.array(list(by_source.values())) / sum(by_source.values())
            assert -(shares * np.log(shares)).sum() >= 0.97 * np.log(len(shares))
        if k == 4:  # ids of the drawn texts as the library has them
            library = Tokenizer.from_file(Q.tokenizer_path())
            rows = out.collect()
            assert Counter(r.doc_id for r in rows) == drawn
            for r in rows:
                ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids)
                assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    assert len(good - kept[0]) <= 0.02 * len(good)
    prints = {r.doc_id: plain_print(r.text) for r in docs.where(F.col("doc_id").isin(*kept[0])).collect()}
    roots = plain_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], d), d)
    assert kept[1] == set(least.values()) and kept[4] == kept[3] == kept[2] == kept[1]


def test_pipeline_with_odd_rows(spark, odd, nothing):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars", "score"), nothing):
        out = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.stored(stage(spark, out, DATA), f"odd-{k}")
            assert k == 4 or out.columns == docs.columns


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 11))
