"""The pipeline's stages, each on its own input, against plain versions of them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_text_operators import clashing, fixture_dir, odd_documents

import corpus_pipeline
from eventloom.llm import langid, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", ["odd", "clashing", "empty"])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    docs = odd_documents(spark)
    docs = {"odd": docs, "clashing": clashing(docs), "empty": docs.limit(0)}[rows]
    sf = fixture_dir(spark, tmp_path, docs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def toxic(text, chain):
    found, earlier = Counter(toxicity.features([text])[0].tolist()), []
    for link in chain:
        x = [float(found[int(f)] >= n) for n in toxicity.LEVELS for f in link.table] + earlier
        z = float(np.dot(link.weights[:-1].astype(np.float64), x) + link.weights[-1])
        earlier.append(float(np.clip(z, -30, 30)))
    return 1 / (1 + np.exp(-z)) >= chain[-1].threshold


def explained(text, table):
    """Whether a text's mixture makes its trigrams likelier than all trigrams alike do."""
    grams, _, begins = langid._trigrams([text])
    if not len(grams):
        return False
    share = langid.mixtures([text], table)[0]
    total = 0.0
    for word in np.split(np.arange(len(grams)), np.flatnonzero(begins)[1:]):
        logs = table[grams[word]].astype(np.float64).sum(0)
        total += np.logaddexp.reduce(np.log(share[share > 0]) + logs[share > 0])
    return total / len(grams) > -16 * np.log(2)


def fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each_class(rows):
    prints = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "", k)
        best[find(k)] = min(best.get(find(k), key), key)
    return [rows[key[-1]] for key in best.values()]


def times_taken(rows):
    """How often the mix takes each row, as (doc_id, text)."""
    size = {s: sum(len(words(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in names}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted(rows, key=lambda r: md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{md5(r['text'] or '')}"))
    out = Counter()
    for s in names:
        before = 0
        for _ in range(2):
            for r in (r for r in order if r["source"] == s):
                n = len(words(r["text"]))
                if n and 2 * (np.floor(target[s] + 0.5) - before) >= n:
                    out[r["doc_id"], r["text"]] += 1
                before += n
    return out


def pieces_of(taken):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (doc_id, text), n in taken.items():
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    return out


def test_every_stage_is_what_a_plain_version_gives(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")
    base = docs.limit(4).collect()
    extra = [(None, base[0]["text"], "en", "s9"), (None, "words of a row without any number", "en", None), (base[1]["doc_id"], "an id on quite another text", "en", "s9"), (9001, base[2]["text"] + " end", "en", None)]
    more = lambda rows: spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    docs.unionByName(more(extra)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(name, docs):
        stage[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    bag = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    chain = toxicity.learn(docs, labels)
    rows, docs = docs.collect(), after("toxicity", docs)
    assert bag(docs.collect()) == bag(r for r in rows if not toxic(r["text"] or "", chain))
    strange = "".join(chr(0x10D0 + k * 7 % 33) + " " * (k % 6 == 5) for k in range(600))
    docs = docs.unionByName(more([(9002, "42 !! 7", "en", "s9"), (9003, None, None, "s9"), (9004, "", "en", "s9"), (9005, strange, None, "s9")]))
    _, table = langid.learn(docs)
    rows, docs = docs.collect(), after("language_id", docs)
    assert bag(docs.collect()) == bag(r for r in rows if explained(r["text"] or "", table)) and docs.count() == len(rows) - 4
    rows, docs = docs.collect(), after("near_dedup", docs)
    assert bag(docs.collect()) == bag(one_of_each_class(rows)) and docs.count() < len(rows)
    rows, docs = docs.collect(), after("mixing", docs)
    assert bag(docs.collect()) == times_taken(rows) and docs.count() > len(rows)
    packed = after("packing", docs).collect()
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, packed)) == pieces_of(bag(docs.collect()))
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_run_is_its_stages_one_after_another(spark, tmp_path):
    sf_dir = fixture_dir(spark, tmp_path, odd_documents(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(key, docs.collect()))


def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        n[name] = docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert 850 < n["toxicity"] < 950 and n["language_id"] >= n["toxicity"] - 5 and n["near_dedup"] < n["language_id"]
    assert docs.select("text").distinct().count() == docs.count()
    assert docs.join(labels.where("toxic = 1"), "doc_id").count() < 10
