"""The text operators against brute force, round trips and held-out rows, and on nulls, ties and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import chat, curriculum, editprint, htmltext, langid, packing, quality, queries, simhash, toxicity, warc
from eventloom.llm.components import component_roots
from eventloom.llm.pagemaker import made_pages

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, extra int"
LONG = "wort " * 60_000


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing and an extra column."""
    rows = [
        (1, "the cat sat on the mat and the dog", "en", "a", 1, "x", 1),
        (1, "the cat sat on the mat and the dog", "en", "a", 1, "x", 1),
        (2, None, "en", "a", None, None, None),
        (3, "", "de", None, 0, "y", 2),
        (4, " \n\t ", None, "b", 3, "z", 3),
        (None, "der hund und die katze", "de", "b", 5, None, None),
        (5, "123 456 !!", "de", "c", 5, "q", None),
        (6, LONG, "de", "c", len(LONG), "q", None),
        (7, "the cat sat on the mat and the dog", "en", "d", 1, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def fixture_dir(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, 0), (2, 0, None), (None, 1, 1), (5, 0, 1), (5, 0, 1), (6, 1, 0)]
    spark.createDataFrame(labels if docs.count() else [], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n[2:4] in ("1_", "2_", "4_", "5_", "8_", "9_", "10")])
def test_document_queries_on_odd_and_empty_tables(spark, tmp_path, name):
    run = queries.QUERIES[name]
    out = run(spark, fixture_dir(spark, tmp_path / "odd", odd_documents(spark)))
    rows = out.collect()
    if name != "op8_best_fit_packing":
        assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, 2, 3, 4, None, 5, 6, 7])
    assert run(spark, fixture_dir(spark, tmp_path / "none", empty(spark))).collect() == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_simhash_matches_brute_force(spark):
    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "A b"), (903, "a B")], "doc_id long, text string"))
    prints = {}
    for r in docs.collect():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (prints[d], find(d)) for d in ids}


@pytest.mark.parametrize("crowded", [2048, 2])
def test_multi_index_loses_no_link(spark, crowded):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 12, np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b) & (1 << 64) - 1
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {0, 1, -1, -(1 << 63), 3, 7, 15}
    ids = sorted(fps)
    distance = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if distance(a, b) <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in ids], "fp long"), crowded=crowded)
    assert all(distance(r["a"], r["b"]) <= 3 for r in edges.collect())
    got = {r["node"]: r["root"] for r in component_roots(edges).collect()}
    assert {d: got.get(d, d) for d in ids} == {d: find(d) for d in ids}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert component_roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_keeps_a_row_of_each_class(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 5, 6]  # 2 stands for all without words


def test_classes_without_a_doc_id_keep_a_row_each(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "quite another text than that"), (7, "one more text with an id here"), (None, "one more text with an id here")]
    kept = simhash.keep_one(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "a b c d e"), (0, "quite another text than that"), (7, "one more text with an id here")]


def test_documents_in_several_languages_are_known(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    some = {r["lang"]: r["text"][:600] for r in docs.where("n_chars between 2000 and 3000").collect()}
    text = " ".join(some[x] for x in sorted(some)[:4])
    share = langid.mixtures([text], model[1])
    assert len(some) > 2 and share.max() < 0.5
    strange = "".join(chr(0x10D0 + k * 7 % 33) + " " * (k % 6 == 5) for k in range(600))
    rng = np.random.default_rng(5)
    random_letters = " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(200))
    rows = [(1, text), (2, some["en"]), (3, "42 !!"), (4, None), (5, ""), (6, strange), (7, random_letters), (8, some["en"] + " " + strange[:40])]
    kept = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 8]
    nothing = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string"), langid.learn(docs.limit(0)))
    assert nothing.collect() == []


def test_an_id_on_several_texts_loses_no_class(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "some unrelated words stand here"), (1, "some unrelated words stand here"), (2, "a third text that is quite different")]
    rows += [(0, "alpha beta gamma delta"), (None, "a third text that is quite different"), (None, None), (7, "")]
    #: One id on many texts, each with a copy under a larger id or none.
    rows += [(-1, f"text number {k} of the many") for k in range(40)] + [(100 + k, f"Text  number {k} of the many") for k in range(0, 40, 2)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    root = {}
    prints = [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for _, t in rows]

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    want = {}
    for n, (fp, (doc_id, text)) in enumerate(zip(prints, rows, strict=True)):
        key = (doc_id is None, doc_id or 0, text is not None, text or "", n)
        want[find(fp)] = min(want.get(find(fp), key), key)
    assert len(want) > 40
    assert sorted(r["n"] for r in simhash.keep_one(docs).collect()) == sorted(k[-1] for k in want.values())


CLASHING = "c d s b h p at row fp id turn before bucket positions position Position_ __turn __fp class_fp component_id size target inside upto rank word n".split()


def clashing(docs):
    """Extra columns with the names that operators may use inside."""
    return docs.drop("extra").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def test_no_name_of_a_column_is_taken(spark):
    docs = clashing(odd_documents(spark))
    model = langid.learn(docs)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], LABELS)
    chain = toxicity.learn(docs, labels)
    kept = {"near": simhash.keep_one(docs), "known": langid.keep_known(docs, model), "clean": toxicity.keep_clean(docs, chain), "mixed": curriculum.training_order(docs, position=None)}
    for name, out in kept.items():
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == k for r in rows for k, c in enumerate(CLASHING)), name
    assert curriculum.training_order(docs).columns == [*docs.columns, "position__"]
    for run in (curriculum.mix, simhash.near_duplicates, editprint.edited_fingerprints, quality.text_statistics, packing.pack_documents, lambda d: langid.identify(d, model), lambda d: toxicity.score(d, chain)):
        assert run(docs).count() >= 9


def test_many_rows_of_one_id_are_mixed_over_many_buckets(spark):
    docs = spark.createDataFrame([(None, f"text number {k}", "a") for k in range(400)], "doc_id long, text string, source string")
    assert curriculum._sized(docs).select("bucket").distinct().count() > 300
    rows = curriculum.mix(docs).collect()
    assert sum(r["taken"] for r in rows) == 1800 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert curriculum.training_order(docs).count() == 600


def test_language_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    rows = found.collect()
    assert len(rows) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    some = {r["lang"]: r["text"] for r in docs.where("n_chars between 2000 and 3000").collect()}
    names, table = model
    share = langid.mixtures([some["en"][:1500] + " " + some["fr"][:1500], "42 !!", ""], table)
    assert 0.3 < share[0][names.index("en")] < 0.7 and 0.3 < share[0][names.index("fr")] < 0.7
    assert not share[1:].any()


def plain_mixture(text, table):
    """Shares of the languages in one text, by words and loops."""
    grams, _, begins = langid._trigrams([text])
    n_langs = table.shape[1]
    score, like = [], []
    for gram, begin in zip(grams.tolist(), begins.tolist(), strict=True):
        score = score + [np.zeros(n_langs)] if begin else score
        score[-1] = score[-1] + table[gram]
    if not score:
        return [0.0] * n_langs
    like = [[np.exp(max(x - max(s), -60)) for x in s] for s in score]

    def em(share):
        for _ in range(langid.ROUNDS):
            new = [0.0] * n_langs
            for row in like:
                total = sum(p * q for p, q in zip(row, share, strict=True))
                for k in range(n_langs):
                    new[k] += row[k] * share[k] / total / len(like)
            moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
            share = new
            if moved < 2e-3:
                break
        return share, sum(np.log(sum(p * q for p, q in zip(row, share, strict=True))) for row in like)

    share, fit = em([1 / n_langs] * n_langs)
    price = langid.PENALTY * 0.5 * np.log(len(like) + 1.0)
    while sum(s > 0 for s in share) > 1:
        least = min((k for k in range(n_langs) if share[k] > 0), key=lambda k: share[k])
        fewer = [0.0 if k == least else s for k, s in enumerate(share)]
        fewer, fit_fewer = em([s / max(sum(fewer), 1e-9) for s in fewer])
        if fit_fewer + price < fit:
            break
        share, fit = fewer, fit_fewer
    return share


def test_mixtures_match_a_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, table = langid.learn(docs)
    texts = [r["text"][:400] for r in docs.where("n_chars > 50").limit(40).collect()]
    texts = [*texts, texts[0] + " " + texts[1], "", "42", "ein"]
    found = [langid.mixtures([t], table)[0] for t in texts]  # alone, as the rounds end when all texts of a batch have settled
    want = [plain_mixture(t, table.astype(np.float64)) for t in texts]
    assert np.abs(np.array(found) - np.array(want)).max() < 0.02
    assert [np.flatnonzero(f).tolist() for f in found] == [np.flatnonzero(w).tolist() for w in want]


def test_held_out_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_warc_round_trip_and_zip64(spark, tmp_path):
    big = "x" * 150
    rows = [(1, "http://a/\nb", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", big), (7, "é", "é" * 200), (8, "z", LONG), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    archives = warc.write_archives(pages, f"file://{tmp_path}")
    records = warc.read_archives(archives, run_records=2)
    payload = {(r["page_id"], bytes(r["payload"]).decode()) for r in records.collect() if r["record_type"] == "response"}
    assert payload == {(1, big), (3, ""), (4, ""), (5, "short"), (6, "short"), (7, "é" * 200), (8, LONG)}
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.verified(records).collect())
    assert got[(2, 150, "revisit", 1)] == 2 and got[(None, 150, "revisit", 1)] == 1 and got[(7, 400, "response", None)] == 1 and sum(got.values()) == 10
    import pyarrow.fs

    place = str(archives.first()["path"]).removeprefix("file://")
    with pyarrow.fs.LocalFileSystem().open_input_file(place) as file:
        found = warc.members(file)
    import zipfile

    with zipfile.ZipFile(place) as z:
        assert {i.filename: i.file_size for i in z.infolist()} == {k: v[2] for k, v in found.items()}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert warc.round_trip(pages.limit(0)).collect() == []
    with zipfile.ZipFile(place) as z:
        raw, heads = z.read(warc.WARC_MEMBER), []
    at = 0
    while at < len(raw):  # a gzip member after the other, as any reader of such files goes through them
        member = zlib.decompressobj(31)
        heads.append(member.decompress(raw[at:]).partition(b"\r\n\r\n")[0].decode())
        at = len(raw) - len(member.unused_data)
    assert "WARC-Type: warcinfo" in heads[0] and all(h.startswith("WARC/1.1\r\n") for h in heads)
    ids = re.findall(r"WARC-Record-ID: <urn:uuid:([-0-9a-f]{36})>", "\n".join(heads))
    assert len(set(ids)) == len(heads)
    assert all(warc.SAME_PAYLOAD in h for h in heads if "WARC-Type: revisit" in h) and all("WARC-Target-URI: " in h for h in heads[1:])


def test_zip64_directory_is_parsed(tmp_path):
    import io
    import struct
    import zipfile

    import pyarrow as pa

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a", b"hello")
        z.writestr("b", b"world!!")
    raw = bytearray(data.getvalue())
    end = raw.rfind(warc.END)
    *_, count, length, offset, _ = struct.unpack_from(warc.END_FIELDS, raw, end + 4)
    record = warc.END64 + struct.pack(warc.END64_FIELDS, 44, 45, 45, 0, 0, count, count, length, offset)
    locator = warc.LOCATOR64 + struct.pack(warc.LOCATOR_FIELDS, 0, end, 1)
    short = warc.END + struct.pack(warc.END_FIELDS, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = bytes(raw[:end]) + record + locator + short
    found = warc.members(pa.BufferReader(wide))
    assert {k: wide[v[1] : v[1] + v[2]] for k, v in found.items()} == {"a": b"hello", "b": b"world!!"}
    with pytest.raises(ValueError):
        warc.members(pa.BufferReader(b"not a zip file at all"))


def test_edit_fingerprints_match_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in editprint.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        alone = editprint.fingerprint_texts([text])[0].tobytes().hex()
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), alone)
    assert np.median([r["near_edited"] for r in got.values()]) > 0.5 > 0.1 > np.median([r["near_next"] for r in got.values()])
    one = editprint.edited_fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def plain_print(text):
    """The walk a step at a time: the byte of each slot for one text."""
    points = [ord(c) for c in text]
    kinds = editprint._classes(np.array(points, np.int64)).tolist() if points else []
    wanted = editprint.places_for(np.array([len(points)]))[0].tolist()
    at, pointers = 0, {}
    for step in range(max(wanted) + 1):
        pointers[step] = at
        if at < len(points):
            at += int(editprint._STEPS[step % editprint.PERIOD][kinds[at]])
    out = []
    for step in wanted:
        key = 0
        for k in range(editprint.GRAM):
            point = points[pointers[step] + k] if pointers[step] + k < len(points) else 0
            key = (key * 0x100000001B3 + point + 1) % (1 << 64)
        out.append(int(editprint.mix64(np.array([key], np.uint64))[0]) >> 56)
    return bytes(out)


def test_likeness_and_classes_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").select("doc_id", "text")
    some = [r["text"] for r in docs.where("n_chars > 500").limit(8).collect()]
    extra = [(9000 + 10 * k + m, t[:200] + "x" * m + t[200:]) for k, t in enumerate(some) for m in range(4)] + [(8999, ""), (9998, None), (9999, some[0])]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_edit_fingerprints"](spark, str(tmp_path)).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    prints = {d: plain_print(t) for d, t in rows}
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for (doc_id, text), (other, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = plain_print(text[: len(text) - cut] + following[:cut])
        r = got[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[doc_id].hex(), edited.hex())
        assert (r["near_edited"], r["near_next"]) == (same(prints[doc_id], edited), same(prints[doc_id], prints[other]))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and same(prints[a], prints[b]) >= editprint.LIKENESS:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: r["class_id"] for d, r in got.items()} == {d: find(d) for d in prints}
    assert len(set(map(find, prints))) < len(prints) - 10


@pytest.mark.parametrize("crowded", [4096, 2])
def test_near_links_connect_what_brute_force_does(spark, crowded):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 400").limit(30).collect()
    texts = [r["text"] for r in base] + [r["text"][:300] + "xyz" * k + r["text"][300:] for r in base for k in (1, 3)]
    prints = editprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = prints.select(F.unhex("fingerprint").alias("fingerprint"))
    of = sorted({bytes(r["fingerprint"]) for r in prints.collect()})
    codes = [np.frombuffer(x, np.uint8) for x in of]
    found = [{"a": bytes(r["a"]), "b": bytes(r["b"])} for r in editprint.near_links(prints, crowded=crowded).collect()]
    near = [(x, y) for k, x in enumerate(of) for m, y in enumerate(of) if m > k and editprint.likeness(codes[k], codes[m]) >= editprint.LIKENESS]
    assert near and {(r["a"], r["b"]) for r in found} <= set(near)

    def classes(pairs):
        root = {x: x for x in of}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            a, b = sorted((find(x), find(y)))
            root[b] = a
        return {x: find(x) for x in of}

    assert classes((r["a"], r["b"]) for r in found) == classes(near)
    with pytest.raises(ValueError):
        editprint.near_links(prints, at_least=0.5)


def test_curriculum_meets_targets_and_orders(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = curriculum.mix(docs).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) <= 2 and all(0 <= p <= 1 for p in r["positions"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    # brute-force water filling
    names = sorted(size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, want, total = set(), {}, 1.5 * sum(size.values())
    while True:
        rest = total - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2 * size[s] if s in full else level * weight[s] for s in names}
    assert all(abs(want[s] - target[s]) < 1e-6 * want[s] for s in names)
    order = curriculum.training_order(docs).select("position", "doc_id", "text", F.spark_partition_id().alias("p")).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert {r["doc_id"]: r["text"] for r in order}.items() <= {r["doc_id"]: r["text"] for r in docs.collect()}.items()


def test_positions_invert_the_schedule(spark):
    row = spark.range(1).select(*[curriculum._position(F.lit(30.0), F.lit(100.0), F.lit(float(a))).alias(f"p{k}") for k, a in enumerate((0.5, 0.0, -0.5))]).first()
    for p, a in zip(row, (0.5, 0.0, -0.5), strict=True):
        assert abs(100 * (p + a * (p * p - p)) - 30) < 1e-9


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys:\\tem", ""]), st.text(alphabet="\\#</turn> :\nA", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_template_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert chat.loss_text(formatted, spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_layouts_and_unknown_schemas(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"prompt":"a","response":"b"}'),
        (4, '{"instruction":"a","output":"b"}'),
        (5, '{"dialog":{"turns":[{"speaker":"user","utterance":"a"},{"speaker":"bot","utterance":"b"}]}}'),
        (6, '{"what":"a"}'),
        (7, None),
        (8, "{broken"),
        (9, '{"messages":[]}'),
    ]
    rows = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    assert len({rows[k]["formatted"] for k in range(1, 6)}) == 1 and rows[1]["mapping"] == "messages"
    assert all(rows[k]["formatted"] is None for k in (6, 7, 8)) and rows[9]["formatted"] == ""


def test_roles_of_conversations_stay_as_they_are(spark):
    rows = [(c, k, role, f"text {k}") for c in (1, 2, 3, 4) for k, role in enumerate([("human", "gpt"), ("user", "model", "bot"), ("human", "gpt", "assistant"), ("user", "assistant", "user")][c - 1])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_records(chat.conversation_records(turns))
    assert {r["conv_id"]: chat.parse_turns(r["formatted"]) for r in made.collect()} == {c: [(r, t) for x, _, r, t in rows if x == c] for c in (1, 2, 3, 4)}
    got = {r["conv_id"]: (r["turns_sha256"], r["loss_chars"]) for r in chat.read_back(made).collect()}
    for c in (1, 2, 3, 4):
        own = [(r, t) for x, _, r, t in rows if x == c]
        assert got[c] == (hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), sum(len(t) for r, t in own if r == "assistant"))


def test_chat_conversations_with_nulls(spark):
    rows = [(1, 1, "user", None, 5), (1, 2, None, "x", 5), (None, None, "assistant", "y", 5), (2, 1, "user", "a", 5), (2, 1, "user", "a", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_records(chat.conversation_records(turns))).collect()}
    assert got == {1: 2, None: 1, 2: 2}
    assert chat.conversation_records(turns.limit(0)).collect() == []


def test_labeller_on_made_and_broken_pages(spark):
    weights = htmltext.model()
    right = total = 0
    for page, truth in made_pages(150, 77):
        blocks = htmltext.blocks_of(page)
        odds = htmltext.scores(weights, [htmltext.Page(blocks)])[0]
        right += sum((o > 0) == (t in truth) for o, (_, t, _) in zip(odds, blocks, strict=True))
        total += len(blocks)
    assert right / total > 0.97
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<script>x"), (4, "u", "<article><h1>A &amp; b</h1><p>One\n two&nbsp;<b>three</b>.<br>four</article><nav><a href=/>Home</a></nav>")]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "", 0), (3, "", 0), (4, "A & b\nOne two three. four", 25)}


@pytest.mark.parametrize(
    "between, text",
    [(f"<{x}></{x}>", "") for x in ("video-player", "title-bar", "svg-icon", "object-view", "audio-player", "style-guide")]
    + [("<svg/>", ""), ('<svg class="i" />', ""), ("<math/>", ""), ("<video>", ""), ("<audio src=a>", ""), ("<canvas>", ""), ("<object data=a>", ""), ("<iframe src='a'/>", ""), ("<video><source src=a>no player</video>", "")]
    + [("<svg><text>a</text><svg><text>b</text></svg>c</svg>", ""), ("<svg>a<!-- </svg> -->b</svg>", ""), ("<video><p>seen</p><video>not seen</video>", "seen"), ("</video>", ""), ("<SCRIPT>if (a < b) '</p>'</SCRIPT >", "")]
    + [("<p><math><mi>x</mi></math></p>", "x"), ("<p>y <object>fallback</object></p>", "y fallback"), ("<noscript><p>plain</p></noscript>", "plain"), ("<textarea>t</textarea>", ""), ("<template><p>t</p></template>", "")],
)
def test_no_element_swallows_what_is_behind_it(between, text):
    got = [t for _, t, _ in htmltext.blocks_of(f"<article><p>first</p>{between}<p>rest</p></article>")]
    assert got == ["first", *([text] if text else []), "rest"]
    assert htmltext.blocks_of("<p>a</p><script>x<p>b</p>")[-1][1] == "a"


def test_pages_of_the_table_give_their_articles(spark):
    import html

    for r in htmltext.main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p)


def test_token_ids_are_the_tokenizer_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "a  b\n\n c", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|\n<|ENDOFTEXT|>", "é\u00a0²½Ⅷ 12٣", "don't I'LL", "\U0001f600 ok", "x" * 5000, "\t\r\n\x0b", "a\u2028b", "ſ's"]
    own = packing.encoder(packing.VOCABULARY)
    assert [own(t) for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_gapless_and_complete(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, shard_pieces=300).collect()
    own = packing.encoder(packing.VOCABULARY)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    bins = {}
    for d in docs.collect():
        ids = np.array([*own(d["text"] or ""), 0], "<u4")
        at = 0
        parts = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and all(p["length"] == 2048 for p in parts[1:])
        for p in parts:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    #: A shard takes a sequence more than its lower bound at most here.
    shards = {}
    for r in rows:
        shards.setdefault(r["sequence_id"] >> 32, []).append(r["length"])
    least = sum(packing.lower_bound(np.array(s), 2048) for s in shards.values())
    assert least <= len(bins) <= least + len(shards) and len(shards) > 3


def test_pieces_without_ids_are_dealt_over_shards(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 300 + [(7, f"text {k % 3}") for k in range(300)], "doc_id long, text string")
    rows = packing.pack_documents(docs, capacity=32, shard_pieces=100).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 600 and len(sizes) == 6 and max(sizes.values()) < 200
    long = packing.pack_documents(spark.createDataFrame([(1, "wort " * 5000)], "doc_id long, text string"), capacity=8, shard_pieces=100)
    assert long.select(F.expr("shiftright(sequence_id, 32)").alias("s")).distinct().count() > 10


def test_lower_bound_is_below_every_packing():
    from itertools import product

    def best(sizes, capacity):
        n = len(sizes)
        return min(len(set(w)) for w in product(range(n), repeat=n) if all(sum(s for s, x in zip(sizes, w, strict=True) if x == b) <= capacity for b in set(w)))

    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 11, 5)
        least, where = best(sizes.tolist(), 10), packing.pack(sizes, 10)[0]
        assert packing.lower_bound(sizes, 10) <= least <= where.max() + 1 <= least + 1
    assert packing.lower_bound(np.full(7, 6), 10) == 7 and packing.lower_bound(np.empty(0, np.int64), 10) == 0


def test_local_search_empties_bins():
    # best fit leaves 3 bins, though two hold all: 6+4 | 5+5 of 10
    bins = packing.Bins(10)
    for item, (size, bin_) in enumerate([(6, -1), (5, -1), (4, -1), (5, -1)]):
        bins.put(item, size, bin_)
    packing.improve(bins)
    assert sorted(sorted(b.values()) for b in bins.items if b) == [[4, 6], [5, 5]]
    # needs an exchange: 7 can take the place of 4 and 2
    bins = packing.Bins(10)
    bins.put(0, 4, -1), bins.put(1, 2, 0), bins.put(2, 3, 0), bins.put(3, 7, -1), bins.put(4, 4, -1)
    before = [dict(b) for b in bins.items]
    packing.improve(bins)
    assert len([b for b in bins.items if b]) == 2, before


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=100, deadline=None)
def test_packing_any_sizes(sizes):
    where, offset = packing.pack(np.array(sizes, np.int64), 50)
    for bin_ in set(where.tolist()):
        at = 0
        for o, s in sorted((offset[k], sizes[k]) for k in np.flatnonzero(where == bin_)):
            assert o == at
            at += s
        assert at <= 50


def brute_statistics(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics_match_brute_force(spark):
    extra = [None, "", "a b c d e f g h " * 3, "x\nx \nx\n\n \n", "é\u00a0 #|<>", "a\u2028b\x1fc\x85d"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r[1:6]) for r in quality.text_statistics(docs).select("doc_id", *quality.STATS).collect()}
    assert got == {r["doc_id"]: brute_statistics(r["text"]) for r in docs.collect()}


def test_rules_hold_on_rows_they_were_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.text_statistics(docs)
    rules = quality.learn_verdict(stats, labels.where("doc_id % 2 = 0"))
    rows = stats.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", (~quality.base_failed() & quality.verdict(rules)).alias("kept"), quality.base_failed().alias("base")).collect()
    good, bad = [r for r in rows if r["quality"] == 1 and not r["base"]], [r for r in rows if r["quality"] == 0]
    assert rules and np.mean([r["kept"] for r in good]) > 0.97 and np.mean([not r["kept"] for r in bad]) > 0.8
    assert quality.learn_rules(np.zeros((0, 2)), np.zeros(0, bool), ["a", "b"]) == []


def test_rules_find_planted_conditions_and_their_verdict_is_the_list():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.9) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality.learn_rules(x, bad, ["a", "b", "c"])
    said = np.zeros(len(x), bool)
    for rule in rules:
        for row in np.flatnonzero(~said):
            said[row] = all(x[row, "abc".index(n)] >= cut if sign == ">=" else x[row, "abc".index(n)] < cut for n, sign, cut in rule)
    assert (said == bad).mean() > 0.98 and 2 <= len(rules) <= 6
    left = np.ones(len(x), bool)
    for rule in rules:  # each rule is precise on what the ones before it leave
        hit = left & quality._covers(rule, x, ["a", "b", "c"])
        assert bad[hit].mean() >= quality.PRECISION
        left &= ~hit


def test_kept_is_the_decision_list_row_by_row(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_verdict(quality.text_statistics(docs), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.QUERIES["op10_quality_rules"](spark, sf).collect():
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_statistics(texts[r["doc_id"]])
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if words(x)]
        capitals = sum("A" <= c <= "Z" for c in texts[r["doc_id"]] or "")
        value = {"n_words": n_words, "word_length": word_chars / max(n_words, 1), "symbols_per_word": n_symbols / max(n_words, 1), "duplicate_lines": n_dup / max(len(lines), 1), "repeated_words": n_repeat / max(n_words, 1), "capitals": capitals / max(word_chars, 1), "words_per_line": n_words / max(len(lines), 1)}
        failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        hit = any(all(value[n] >= cut if sign == ">=" else value[n] < cut for n, sign, cut in rule) for rule in rules)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not hit), r


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    caught = [r["is_toxic"] for r in rows if r["toxic"] == 1]
    clean = [not r["is_toxic"] for r in rows if r["toxic"] == 0]
    assert np.mean(caught) > 0.7 and np.mean(clean) > 0.95
    assert all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_low_quality"] <= 1 for r in rows)
    # a later link's input holds the earlier one's log-odds
    assert len(chain[1].weights) == len(toxicity.LEVELS) * len(chain[1].table) + 2


def labelled(x, y, fold):
    """A sample for training from features (row x feature), all candidates in order."""
    bits = np.packbits(np.stack([x.T, x.T & False, x.T & False]), axis=2)
    order = [[np.arange(x.shape[1])] * (toxicity.FOLDS + 1)] * y.shape[1]
    return toxicity.Labelled(bits, y, fold, order)


def train_here(data, names, top):
    data, used = toxicity.selected(data, top)
    return toxicity.train_chain(data, used.astype(np.uint64), names, lambda k, earlier: [toxicity.fit_without(data, k, f, earlier) for f in range(toxicity.FOLDS + 1)])


def test_earlier_categories_are_fed_out_of_fold():
    rng = np.random.default_rng(0)
    noise = rng.random((400, 60)) < 0.3
    first = rng.random(400) < 0.5
    data = labelled(np.hstack([noise, first[:, None]]), np.stack([first, first], 1).astype(int), np.arange(400) % 5)
    data.order = [[np.arange(61)] * 6, [np.arange(60)] * 6]  # the second doesn't see the feature that says it
    chain = train_here(data, ["a", "b"], 61)
    assert chain[1].weights[-2] > 5 * np.abs(chain[1].weights[:-2]).mean()  # the second can only know from the first


def test_what_only_a_fold_knows_is_not_fed_to_the_next_model():
    """Every row has a feature of its own, which says its category: out of fold it is worth nothing."""
    rng = np.random.default_rng(1)
    y = (rng.random(100) < 0.5).astype(int)
    x = np.hstack([np.eye(100, dtype=bool), rng.random((100, 3)) < 0.5])
    data = labelled(x, np.stack([y, y], 1), np.arange(100) % 5)
    data, _ = toxicity.selected(data, 103)
    fitted, odds = toxicity.fit_without(data, 0, 5, np.empty((100, 0), np.float32))[2], np.zeros(100)
    for fold in range(5):
        some = toxicity.fit_without(data, 0, fold, np.empty((100, 0), np.float32))[2]
        odds[data.fold == fold] = some[data.fold == fold]
    assert ((fitted > 0) == y).mean() > 0.95 and abs(((odds > 0) == y).mean() - 0.5) < 0.2


def test_near_copies_are_in_one_fold(spark):
    rows = [(k, f"word{k % 7} one two three four five six seven eight nine ten eleven {'x' * (k % 2)}", k % 2) for k in range(40)]
    got = toxicity.with_folds(spark.createDataFrame(rows, "doc_id long, text string, y0 int")).collect()
    assert len(got) == 40
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) & (1 << 64) - 1 for r in got}
    folds = {r["doc_id"]: r["fold"] for r in got}
    assert all(folds[a] == folds[b] for a in folds for b in folds if (prints[a] ^ prints[b]).bit_count() <= 3)
    assert len(set(folds.values())) > 1


def test_probabilities_are_those_of_the_plain_chain(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.learn(docs, labels, top=32)
    for r in toxicity.score(docs, chain).join(docs.select("doc_id", "text"), "doc_id").limit(60).collect():
        found = Counter(toxicity.features([r["text"]])[0].tolist())
        earlier = []
        for link in chain:
            x = [float(found[int(f)] >= n) for n in toxicity.LEVELS for f in link.table] + earlier
            z = sum(float(w) * v for w, v in zip(link.weights, x, strict=False)) + float(link.weights[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            assert abs(r[f"p_{link.name}"] - p) < 1e-5 and (r[f"is_{link.name}"] == (p >= link.threshold) or abs(p - link.threshold) < 1e-6)
            earlier.append(float(np.clip(z, -30, 30)))


def test_copies_of_one_document_leave_room_for_other_features():
    rng = np.random.default_rng(5)
    copies = np.repeat(rng.random((200, 1)) < 0.2, 30, axis=1)  # thirty words of one document and its copies
    words = rng.random((200, 5)) < 0.3
    present = np.packbits(np.hstack([copies, words]).T, axis=1)
    every = np.packbits(np.ones(200, bool))
    assert toxicity.distinct_features(present, np.arange(35), 6, every).tolist() == [0, 30, 31, 32, 33, 34]
    assert toxicity.distinct_features(np.zeros((3, 0), np.uint8), np.arange(3), 2, np.empty(0, np.uint8)).tolist() == [0, 1]


@pytest.mark.parametrize("folder", ["file:{}", "file://{}", "{}", "{}/"])
def test_archives_in_a_folder_however_it_is_spelt(spark, tmp_path, monkeypatch, folder):
    monkeypatch.setattr(warc, "scratch", lambda _, kind: folder.format(tmp_path).rstrip("/") + f"/{kind}-1")
    pages = spark.createDataFrame([(1, "http://a/", "x" * 120), (2, None, "x" * 120), (None, "u", None)], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.round_trip(pages).collect()) == [(0, "response"), (1, "response"), (2, "revisit")]


def test_the_folder_that_only_the_context_knows(spark, tmp_path, monkeypatch):
    """Hadoop spells the checkpoint folder file:/x where spark.checkpoint.dir isn't set; twice in one session."""
    from eventloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: spark.sparkContext.getCheckpointDir() or f"file:{tmp_path}")
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    for _ in range(2):
        assert warc.round_trip(pages).count() == 1


def test_the_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0)], LABELS)
    rows = [toxicity.labelled_sample(docs, labels, sample=n).collect() for n in (1, 10)]
    assert len(rows[0]) == 1 and len(rows[1]) == 10
