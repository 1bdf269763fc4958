"""Conversation repair, URL templates and source divergence against plain versions, and on odd and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import divergence, queries, repair, urltree

# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string, digest string, part int, pos long"


def plain_repair(rows):
    """The same by trying every string of edits, kept as strings: rows (role, text) in order."""
    seen, best = set(), {"": (0, "", ())}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        found = dict(states)
        for state, (cost, audit, said) in states.items():
            for _ in range(3):
                state = follow[state]
                cost, audit, said = cost + 5, audit + "I", (*said, f"{names[state]}:")
                if state not in found or (cost, audit) < found[state][:2]:
                    found[state] = (cost, audit, said)
        return found

    faults = Counter()
    for role, text in rows:
        blank, copy = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not blank and not copy and re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text).group() not in ".!?"
        seen.add((role, text))
        faults["blank" if blank else "duplicate" if copy else "truncated" if cut else ""] += 1
        after = {}

        def way(state, cost, audit, said):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, said)

        #: Inserts can stand before any row; every number of them up to three is tried.
        before = [(s, *v) for s, v in best.items()]
        for state, cost, audit, said in list(before):
            for _ in range(3):
                state = follow[state]
                cost, audit, said = cost + 5, audit + "I", (*said, f"{names[state]}:")
                before.append((state, cost, audit, said))
        for state, cost, audit, said in before:
            way(state, cost + 2, audit + "D", said)
            if blank or copy:
                continue
            cost += 5 if cut else 0
            first = role[:1]
            if (first == "s" and state == "") or (first in ("u", "a") and first == follow[state]):
                way(first, cost, audit + "K", (*said, f"{role}:{text}"))
            way(follow[state], cost + 1, audit + "R", (*said, f"{names[follow[state]]}:{text}"))
        best = after
    ends = [v for s, v in inserted(best).items() if s in ("", "a")]
    cost, audit, said = min(ends, key=lambda v: v[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_report(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        damaged = conversations[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        damaged += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    found = {}
    for conv, damaged in conversations.items():
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in damaged if t is not None}
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain_repair([r[1:] for r in damaged]))
    return found


def reported(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1, None) for r in rows], TURNS)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = repair.report(repair.damaged(turns), turns).collect()
    assert len(out) == len({r["conv_id"] for r in out})
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in out}


def odd_turns(n, convs, seed):
    rng = random.Random(seed)
    roles, texts = [None, "", "system", "user", "assistant", "assistant", "user", "tool", "s"], [None, "", " \t", "a.", "b", "c!\n", "Ünd? ", "x y z.", "\u00a0", "😀"]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_matches_every_edit_tried(spark):
    rows = odd_turns(1500, [None, -3, *range(120)], 1)
    assert reported(spark, rows) == plain_report(rows)


def test_a_long_conversation_is_cut_into_segments(spark):
    """One conversation holds nearly all rows, many of them equal; more tasks than conversations."""
    rows = odd_turns(900, [7], 2) + [(7, 40, "user", "again.")] * 40 + [(8, k, "user" if k % 2 else "assistant", "w " * 30_000 + ".") for k in range(3)]
    rows += [(7, 50 + k, ("user", "assistant", "tool")[k % 3], f"turn {k}" + "." * (k % 4 > 0)) for k in range(900)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert reported(spark, rows) == plain_report(rows)
        turns = spark.createDataFrame([(*r, "x", 1, None) for r in rows], TURNS)
        work = repair.Repair(repair.damaged(turns))
        assert work.edits.where("conv_id = 7").count() > 10
        by_segment, whole = ([tuple(r) for r in work.repaired(w).orderBy("conv_id", "segment", "place").collect()] for w in (False, True))
        assert by_segment == whole
        roles = "".join(r[4][0] for r in whole if r[0] == 7)
        assert re.fullmatch("(s?(ua)+)?", roles)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repair_of_nothing(spark):
    assert reported(spark, []) == {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=9), st.lists(st.integers(0, 9), max_size=3))
def test_segments_join_to_the_whole(rows, cuts):
    """Solved whole or cut anywhere, cost and audit are the same, and those of strings."""
    def solve(parts):
        segments = []
        for part in parts:
            seg = repair.Segment()
            for kind, fault in part:
                seg.add(kind, fault)
            segments.append(seg)
        cost, path, run = repair.joined_path([(s.totals(), list(s.ranks)) for s in segments])
        macros = b"".join(repair.read_back(bytes(s.parents), e, q) for s, (e, q) in zip(segments, path))
        return cost, "".join(map(repair.MACROS.__getitem__, macros)) + "I" * run

    cuts = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    texts = iter(range(100))
    plain = [(("tool", "system", "user", "assistant")[k], "" if f == 2 else f"{next(texts)}" + ("." if f == 0 else "")) for k, f in rows]
    whole = solve([rows])
    assert whole == solve([rows[a:b] for a, b in zip(cuts, cuts[1:])] or [[]]) == plain_repair(plain)[4:6]


# ---- URL templates

PAGES = "page_id long, url string, host string, rule string, key int"
RULES = (urltree.Rule("block", "shop.example", "/buy/now/1"), urltree.Rule("allow", "shop.example", "/buy/now/17"), urltree.Rule("block", "net", "/"), urltree.Rule("block", "mixed.example", "/a/1"))


def judged(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], PAGES)
    return [r for r in urltree.judge(pages, rules, **options).orderBy("page_id").collect()]


def test_hosts_paths_and_longest_rules(spark):
    urls = ["http://A.Net/x", "HTTPS://b.a.net", "://net/", "http://anet/x", None, "no scheme", "x://a.example.NET/en/1?u=://b.org/fr/", "http://q.org/fr/2#/x", "http://m.Example.com/de/", "http://example.com/deep"]
    rows = judged(spark, urls, urltree.RULES)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [
        ("a.net", "/x", "net/", "block"),
        ("b.a.net", "", None, "allow"),
        ("net", "/", "net/", "block"),
        ("anet", "/x", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("q.org", "/fr/2", "org/fr/", "allow"),
        ("m.example.com", "/de/", "example.com/de/", "block"),
        ("example.com", "/deep", None, "allow"),
    ]


def test_templates_carry_labels_over(spark):
    """/buy/now/# has blocked urls only, so its others are rejected; the host's other branches, and a template with labels of both kinds, aren't."""
    urls = [f"http://shop.example/buy/now/{k}" for k in range(100, 130)] + [f"http://shop.example/buy/now/{k}" for k in range(20, 60)]
    urls += [f"http://shop.example/{lang}/item/{k}/" for lang in ("en", "fr") for k in range(40)] + ["http://shop.example/buy/later/1", "http://shop.example/buy"]
    urls += [f"http://mixed.example/a/{k}" for k in range(30)]
    rows = judged(spark, urls)
    by = {r["path"] + "@" + r["host"]: r["verdict"] for r in rows}
    assert {by[f"/buy/now/{k}@shop.example"] for k in range(20, 60)} == {"block"}
    assert {v for k, v in by.items() if k.startswith(("/en", "/fr", "/buy/later", "/buy@"))} == {"allow"}
    assert by["/a/2@mixed.example"] == "block" and by["/a/1@mixed.example"] == "block"
    rows = judged(spark, urls, RULES[:3] + (urltree.Rule("block", "mixed.example", "/a/1"), urltree.Rule("allow", "mixed.example", "/a/2")))
    assert {r["path"]: r["verdict"] for r in rows if r["host"] == "mixed.example"}["/a/3"] == "allow"


def test_rare_segments_are_wildcards_and_alike_branches_merge(spark):
    urls = [(f"h.example", f"/{lang}/x{'y' * k}/{k}", None) for lang in ("de", "en", "fr") for k in range(40)] + [("h.example", f"/bad/x{'y' * k}", "block") for k in range(40)]
    found = urltree.templates(spark.createDataFrame(urls, "host string, path string, label string"))
    assert {r["template"]: r["n"] for r in found.groupBy("template").agg(F.sum(F.expr("block + allow + none")).alias("n")).collect()} == {"/de|en|fr/*/#": 120, "/bad/*": 40}
    deep = urltree.templates(spark.createDataFrame([("h", "/a/b/c/d/e/f", None)] * 20 + [("h", "/a/b/c/d", None)] * 20 + [("h", "", None)], "host string, path string, label string"))
    assert {r["template"] for r in deep.collect()} == {"/a/b/c/d/**", "/a/b/c/d", ""}


def test_url_queries_agree_with_sql_on_odd_urls(spark, tmp_path):
    rng = random.Random(3)
    urls = []
    for _ in range(3000):
        host = rng.choice(["a.Shop.example", "shop.example", "x.org", "net", "mixed.example"])
        kind = rng.choice(["now", "later", f"s{rng.choice('abcdefghijklm') * rng.randrange(1, 60)}"])
        urls.append(f"http://{host}/{rng.choice(['en', 'fr', 'buy', 'a', ''])}/{kind}/{rng.randrange(99)}" + rng.choice(["", "/x//y/z/w", "?q=1", "#f", "/0123456789abcdef0123"]))
    urls += [None, "", "://", "http://", "http:///x", "http://h?/x", "http://shop.example" + "/buy" * 5000, "a://b\n/c"] * 3
    rules = RULES + tuple(urltree.Rule("block", "shop.example", f"/buy/now/{k}") for k in range(3, 9))
    pages = spark.createDataFrame([(rng.choice([None, i]), u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, con.execute(urltree.judge_sql(rules)).fetchall()))
    got = sorted(key((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in urltree.judge(pages, rules).collect())
    assert got == want and len(got) == len(urls)
    assert Counter(r[4] for r in got if r[3] == "None")["block"] > 10


# ---- source divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def plain_divergence(rows, least):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(g[1] for g in counts if g[0] == lang)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in groups}
        total = {t: sum(own[s][t] for s in groups) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(own[s]) for s in groups}, share(total)
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, part, x[2], -x[0], i + 1) for part, found in (("pair", pairs), ("term", best)) for i, x in enumerate(found)]
    return sorted(out)


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["der", "Die", "ÄRGER", "ärger", "日本", "x\u00a0y", "a-b", "don't", "z9z", "\u0130", *[f"w{'abcdefgh'[k % 8]}{'qrst'[k % 4]}" for k in range(60)]]
    return [(rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(60)))]), rng.choice([None, "de", "en"]), rng.choice([None, "", "a", "b", "Ä", "c", "rare" + str(rng.randrange(9))])) for _ in range(n)]


@pytest.mark.parametrize("cells, group_block", [(1 << 20, 256), (150, 3)])
def test_divergence_matches_plain_version(spark, cells, group_block):
    rows = odd_texts(4) + [("only here " * 20_000, "xx", "lone"), (None, "yy", None)]
    docs = spark.createDataFrame([(1, *r, "t", 2) for r in rows], DOCS)
    found = divergence.source_divergence(docs, least_docs=12, cells=cells, group_block=group_block)
    assert sorted(tuple(r) for r in found.collect()) == plain_divergence(rows, 12)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**13), st.integers(0, 9 * 10**15 - 10**13)), min_size=1, max_size=8))
def test_shares_are_exact(pairs):
    count, total = np.array([c for c, _ in pairs]), np.array([c + r + 1 for c, r in pairs])
    assert divergence.share(count, total).tolist() == [1 + 1_000_000_000 * int(c) // int(t) for c, t in zip(count, total)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 9), st.integers(1, 40), st.randoms())
def test_pair_sums_in_any_blocks(n, m, width, cells, rng):
    a, b = (np.array([[rng.randrange(10**9) for _ in range(width)] for _ in range(k)], np.int64).reshape(k, width) for k in (n, m))
    want = [[int(sum(abs(int(x) - int(y)) for x, y in zip(r, s))) for s in b] for r in a]
    assert divergence.pair_sums(a, b, cells).tolist() == want


def test_queries_on_odd_and_empty_tables(spark, tmp_path):
    for kind, turns, docs in (("odd", odd_turns(60, [None, 1, 2], 5), odd_texts(6, 50)), ("none", [], [])):
        top = tmp_path / kind
        spark.createDataFrame([(*r, "x", 1, None) for r in turns], TURNS).write.parquet(str(top / "conversations.parquet"))
        spark.createDataFrame([(1, *r, "t", 2) for r in docs], DOCS).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([(1, None, "h", "r", 1)] * len(docs), PAGES).write.parquet(str(top / "pages.parquet"))
        assert {r["conv_id"] for r in queries.QUERIES["op11_conversation_repair"](spark, str(top)).collect()} == {r[0] for r in turns}
        assert queries.QUERIES["op12_url_templates"](spark, str(top)).count() == len(docs)
        found = queries.QUERIES["op13_source_divergence"](spark, str(top)).collect()
        groups = {(lang or "", source or "") for _, lang, source in docs}
        assert Counter((r["lang"], r["source"]) for r in found if r["part"] == "pair") == Counter(a for a, b in itertools.permutations(groups, 2) if a[0] == b[0])
