"""The training-data operators against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafline.llm import common, contamination, html, licences, nearest, packing, pii, quality, queries, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
WORDS = "ka lo mi ne pu ra si to ve wo xi yu za be co du fe gi ho ju".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """(doc_id, text) with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "row", "node", "key", "fps", "hash", "score", "h", "spans", "terms", "length", "task", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(1, None), (2, ""), (3, "one"), (None, "no id here at all"), (4, "same text twice here ok"), (4, "same text twice here ok"), (5, "long " * 30_000), (6, " \t\n\x0b ")]


# -- 1 --------------------------------------------------------------------------------
def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    sh = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(pairs, near):
    ids = [i for i, _ in pairs]
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, x in pairs:
            for j, y in pairs:
                if near(x, y) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


@pytest.mark.parametrize("radius", [2, 4])
def test_covering_family_loses_no_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(1)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [16384, 3])
def test_simhash_components(spark, bucket):
    """Also with tiny buckets, where members meet through balls of values instead."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(40)]
    base = prose(rng, 300).split()
    for i in range(40, 80):
        w = list(base)
        w[rng.randrange(300)] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, t in rows[:5]] + [(200, None), (201, ""), (202, "Ab  cD"), (203, "aB\x0bcd")]
    got = {r.doc_id: r for r in simhash.simhash_components(docs_of(spark, rows), bucket=bucket).collect()}
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    assert {i: got[i].fingerprint & (1 << 64) - 1 for i, _ in rows} == dict(fp)
    assert {i: got[i].component_id for i, _ in rows} == brute_components(fp, lambda x, y: (x ^ y).bit_count() <= 4)


def test_simhash_odd_rows(spark):
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_components(docs_of(spark, ODD)).collect()]
    assert len(got) == len(ODD) and (6, 1) in got and (2, 1) in got and got.count((4, 4)) == 2
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [16384, 4])
def test_near_copies(spark, bucket):
    rng = random.Random(3)
    base, rows = [prose(rng, 250).split() for _ in range(6)], []
    for k, b in enumerate(base):
        for c in range(5):
            w = list(b)
            if c:
                w[rng.randrange(250)] = "edit" + str(c)
            rows.append((10 * k + c, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.near_copy_components(docs_of(spark, rows), bucket=bucket).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in rows)


def jaccard_groups(rows):
    """Smallest id of each component of pairs with a Jaccard similarity of 0.8 on 5-word shingles, by brute force."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_near_copies_by_appended_passages(spark):
    """Passages added in one piece: every pair of 0.8 or more is linked."""
    rng, rows = random.Random(11), []
    for k in range(120):
        w = prose(rng, rng.randint(30, 400)).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + [f"other{k}x{i}" for i in range(int(len(w) * rng.uniform(0.05, 0.24)))]))]
    want = jaccard_groups(rows)
    assert sum(want[2 * k + 1] == 2 * k for k in range(120)) > 90
    assert {r.doc_id: r.component_id for r in simhash.near_copy_components(docs_of(spark, rows)).collect()} == want


def test_near_copies_of_a_large_group(spark):
    """A group far above the bucket bound, whose members differ by more than one representative reaches, keeps every link."""
    rng = random.Random(12)
    base, rows = prose(rng, 200).split(), []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t.replace("edit", "more") + " tail" * (i % 3)) for i, t in rows[:20]]
    assert {r.doc_id: r.component_id for r in simhash.near_copy_components(docs_of(spark, rows), bucket=8).collect()} == jaccard_groups(rows)


def test_near_copies_are_sought_by_fingerprints(spark):
    """Covering tables find the groups of all sets within the radius, and their verified links stand before minimum hashes are asked."""
    rng, rows = random.Random(14), []
    for k in range(12):
        w = prose(rng, 400).split()
        rows += [(10 * k + c, " ".join(w + [f"more{k}x{i}" for i in range(c)])) for c in range(4)]
    cut = common.staged(simhash.sketches(docs_of(spark, rows), "doc_id", "text", 5, 24, 4))
    fps = {r.id: r.fp & (1 << 64) - 1 for r in cut.collect()}
    for i, t in rows:
        w = t.split()
        held = [xxhash.xxh64_intdigest(s) for s in {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}]
        assert fps[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in held) > len(held))
    nodes = cut.select(F.col("row").alias("node"), "n", "fp")
    ids = {r.row: r.id for r in cut.collect()}
    near = common.staged(simhash.fingerprint_groups(nodes, 4, 16384, len(rows)))
    groups = {}
    for r in near.collect():
        groups.setdefault(r.key, set()).add(ids[r.node])
    want = {}
    for i, root in brute_components(sorted(fps.items()), lambda x, y: (x ^ y).bit_count() <= 4).items():
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1) and groups
    sets = cut.select(F.col("row").alias("node"), "lanes", "held")
    comp = simhash.jaccard_components(near, near.limit(0), sets, 0.8, 16384)  # no bands at all
    linked = {}
    for r in comp.collect():
        linked.setdefault(r.component, set()).add(ids[r.node])
    assert sorted(map(sorted, linked.values())) == sorted(map(sorted, groups.values()))


def test_turns_read_only_what_is_open(spark, monkeypatch):
    """Buckets whose members are one component already, by fingerprints or by a turn before, are not read again."""
    rng, rows = random.Random(17), []
    for k in range(8):
        w = prose(rng, 400).split()
        rows += [(10 * k + c, " ".join([*w, *(f"more{k}x{i}" for i in range(c))])) for c in range(3)]
    w = prose(rng, 60).split()
    rows += [(200, " ".join(w)), (201, " ".join(w + ["far", "from", "it", "by", "bits", "of", "a", "print"]))]
    read, turns = [], simhash._turns
    monkeypatch.setattr(simhash, "_turns", lambda members, *rest: (read.append({r.node for r in members.select("node").collect()}), turns(members, *rest))[1])
    got = {r.doc_id: r.component_id for r in simhash.near_copy_components(docs_of(spark, rows)).collect()}
    assert got == jaccard_groups(rows) and got[201] == 200
    assert len(read[0]) >= 20 and len(read[1]) <= 6  # the pair of 200 and what bits left apart


@pytest.mark.parametrize("bound", [200_000, 3])
def test_merged_like_components(spark, monkeypatch, bound):
    """One task or rounds over the cluster: the same components."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    rng = random.Random(18)
    edges = [(i, i + 1) for i in range(500, 400, -1)] + [(7, i) for i in range(8, 60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    want = brute_components([(i, i) for i in sorted({x for e in edges for x in e})], lambda x, y: (x, y) in links or (y, x) in links) if (links := set(edges)) else {}
    got = {r.node: r.component for r in simhash._merged(common.staged(spark.createDataFrame(edges, "a long, b long")), len(edges)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_no_link_below_the_similarity(spark):
    rng, rows = random.Random(13), []
    for k in range(100):
        w = prose(rng, rng.randint(60, 300)).split()
        n = len(w) - 4
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + [f"other{k}x{i}" for i in range(int(n / rng.uniform(0.68, 0.79)) - n + 1)]))]
    assert {r.doc_id: r.component_id for r in simhash.near_copy_components(docs_of(spark, rows)).collect()} == {i: i for i, _ in rows}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(v == (100 if k >= 100 else 1) for k, v in got.items()) and len(got) == 61 + 59


# -- 2 --------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 20, 64, 1024])
    counts = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(rng.choice([1, 3, 10, 100]))}
    held = {}
    plan = packing.reduce_and_fit(counts, cap)
    for many, parts in plan:
        assert many > 0 and sum(s * k for s, k in parts) <= cap
        for s, k in parts:
            held[s] = held.get(s, 0) + many * k
    assert held == counts


@pytest.mark.parametrize("seed", range(30))
def test_reduction_stays_optimal(seed):
    """Against exhaustive search on small instances: at most one sequence more, and never worse than best fit."""
    rng = random.Random(seed)
    cap, items = 10, sorted((rng.randint(2, 9) for _ in range(7)), reverse=True)
    counts = {s: items.count(s) for s in items}

    def fewest(i, rooms):
        if i == len(items):
            return len(rooms)
        options = [fewest(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]]) for k, r in enumerate(rooms) if r >= items[i]]
        return min([*options, fewest(i + 1, [*rooms, cap - items[i]])])

    n = sum(m for m, _ in packing.reduce_and_fit(counts, cap))
    assert fewest(0, []) <= n <= fewest(0, []) + 1


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 50, 900]))) for i in range(30)] + [(50, None), (51, "日本 x y\x1cz <|endoftext|>"), (52, "a <|endoftext|> b"), (53, "<|endoftext|>" * 3000), (54, "x" * 200_000), (55, "the " * 40_000), (None, "z")]
    got = packing.pack(docs_of(spark, rows)).collect()
    place = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = {}
    for s, o, n in place:
        assert o == at.get(s, 0) and o + n <= 1024
        at[s] = o + n
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert sum(p[2] for p in parts) == len(ids) and all(p[2] == 1024 for p in parts[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in parts)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_ids_of_special_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer()).encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(packing.default_tokenizer())("a <|endoftext|> b"), "<u4").tolist() == plain and 50256 in plain


def test_both_encoders_agree():
    """On random texts of every sign that the faster one takes, white space of all kinds and contractions."""
    encode, rng = packing.Encoder(packing.default_tokenizer()), random.Random(14)
    signs = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    odd = ["'s", "'T", "'re", " ", "  ", "\n\n", "\t", "\x85", "\xa0", "\u2028"[:0], "12", "x9", "ß", "²", "½", "\x1c", "…", "Ǆ", "ª"]
    for _ in range(4000):
        text = "".join(rng.choice(signs if rng.random() < 0.4 else odd) for _ in range(rng.randint(0, 40)))
        assert encode.fast(text) == encode.direct(text), repr(text)


def test_plan_of_repeated_lengths_is_short():
    import time

    for counts, cap in (({341: 10**9}, 1024), ({341: 300_000, 340: 7, 1: 3}, 1024), ({5: 10**6 + 1, 3: 10**6, 2: 17}, 16), ({7: 999_983, 4: 999_979, 3: 5}, 20)):
        began = time.time()
        plan = packing.reduce_and_fit(counts, cap)
        held = {}
        for many, parts in plan:
            assert sum(n * k for n, k in parts) <= cap
            for n, k in parts:
                held[n] = held.get(n, 0) + many * k
        assert held == counts and len(plan) < 200 and time.time() - began < 1


# -- 3 --------------------------------------------------------------------------------
SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15}

    def card(s):
        d = [int(x) for x in s if x.isdigit()]
        return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0

    ok["card"] = card
    return [(k, m.start(), m.end()) for k, p in SLOW.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_spans_like_the_patterns():
    rng = random.Random(5)
    fixed = ["a@b.c@d.e", "@b.c@d.e x", "x@y@z.com", "1.2.3.4.5.6.7.8", "256.1.1.1 01.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-11111", "+1 (988) 555-2485 +12", "é a.b@é.c", "+4+44 20 7946 0958...", "1.2.3", "a@b..c", "0000000000000000"]
    for text in fixed + ["".join(rng.choice("ab1245.@+- ()%é") for _ in range(rng.randint(0, 80))) for _ in range(4000)]:
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("n", [40, 400])
def test_a_name_beside_one_address_is_taken_out(spark, n):
    """Rare terms disclose most: no number of documents exempts them, at any size."""
    rows = [(0, "write to zebulon z1@x.org for more words")] + [(i, "write to all for more words") for i in range(1, n)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, rows)).collect()}
    assert "zebulon" not in clean[0] and "write to" in clean[0] and clean[1] == rows[1][1]


def test_disclosing_terms(spark):
    rows = [(i, f"prefix filler words zebra mail u{i}@x.org then more" if i % 4 == 0 else "zip filler words then more mail of prefix") for i in range(200)]
    found = pii.find_private(docs_of(spark, rows), support=20).collect()
    said = {(t.kind, r.doc_id) for r in found for t in r.terms}
    assert said == {("email", i) for i in range(0, 200, 4)}  # zebra stands nowhere else; mail does
    text = dict(rows)
    assert all(text[r.doc_id][t.start : t.stop] == "zebra" and t.removed for r in found for t in r.terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, rows), support=20).collect()}
    assert clean[1] == text[1] and "zebra" not in clean[0] and "[EMAIL]" in clean[0] and "mail" in clean[0]


def brute_terms(rows, window=4, generalise=0.9):
    """{(doc_id, kind, start, stop)} of the terms that disclose a kind, from documents as sets and nothing else."""
    from math import log2

    seen, events, near = {}, {}, {}
    for i, t in rows:
        spans = brute_spans(t or "")
        for w in {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t or "")}:
            seen.setdefault(w, set()).add(i)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")]
        free = [(a, b) for a, b in words if not any(s < b and a < e for _, s, e in spans)]
        for kind, s, e in spans:
            events.setdefault(kind, set()).add(i)
            before, after = [x for x in free if x[1] <= s], [x for x in free if x[0] >= e]
            for a, b in before[-window:] + after[:window]:
                near.setdefault((kind, t[a:b].lower()), set()).add((i, a, b))
    out, n = set(), len(rows)
    for (kind, w), places in near.items():
        c = len(events[kind])
        if c < n and log2(len({i for i, _, _ in places}) * n / (c * len(seen[w]))) / log2(n / c) >= generalise - 1e-12:
            out |= {(i, kind, a, b) for i, a, b in places}
    return out


def test_disclosing_terms_like_brute_force(spark):
    rng, rows = random.Random(16), []
    names = ["zoe", "ann", "bob", "cy", "dora"]
    for i in range(300):
        parts = prose(rng, rng.randint(3, 30)).split() + [rng.choice(["mail", "call", "host"]) for _ in range(3)]
        if i % 3 == 0:
            at = rng.randrange(len(parts))
            parts[at:at] = [rng.choice(names), rng.choice([f"u{i}@x.org", "+44 20 7946 0958", "10.0.0.7", "4111 1111 1111 1111"]), rng.choice(WORDS)]
        rows.append((i, " ".join(parts)))
    rows += [(400, None), (401, "")]
    got = {(r.doc_id, t.kind, t.start, t.stop) for r in pii.find_private(docs_of(spark, rows)).collect() for t in r.terms}
    assert got == brute_terms(rows) and got


def test_sanitise_rows_that_share_an_id(spark):
    rows = [(1, "ask q@x.org now"), (1, "no such thing in this text"), (None, "or z@y.org please"), (2, None)]
    got = sorted((r.doc_id or -1, r.text or "", r.score) for r in pii.sanitise(docs_of(spark, rows)).collect())
    assert [i for i, _, _ in got] == [-1, 1, 1, 2] and {s for _, _, s in got} == {"x"}
    texts = {t for _, t, _ in got}
    assert rows[1][1] in texts and "" in texts and not any("@" in t for t in texts) and sum("[EMAIL]" in t for t in texts) == 2


def test_pii_odd_rows(spark):
    df = docs_of(spark, ODD)
    out = pii.digests(pii.find_private(df)).collect()
    assert len(out) == len(ODD) and {r.base_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    again = pii.sanitise(df)
    assert again.columns == df.columns and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert pii.find_private(docs_of(spark, [])).count() == 0


# -- 4 --------------------------------------------------------------------------------
PAGES = {
    "<article><h1>T &amp; x</h1><p>a<br>b  <b>c</b></p><form>no</form><ul><li>i<li>j</ul></article><footer>f</footer>": "T & x\n\na b c\n\ni\n\nj",
    "<body><nav>n</nav><p>one</p><div class='ad x'>buy<p>more</p></div><p>two</body>": "one\n\ntwo",
    "<main><header><h1>H</h1></header><p>p</p><article class=comment>c</article><aside>s</aside></main>": "H\n\np",
    "<article><p>a</p><article><p>reply</p></article><p>b</p></article>": "a\n\nb",
    "<script>var t='</p>';</script><p title='a>b'>x</p><!-- <p>y</p> -->": "x",
    "plain text &lt;b&gt;": "plain text <b>",
    "<p>unclosed <article><p>in": "in",
    "": "",
    None: "",
}


def test_extract(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.x/", p, "x", 1) for i, p in enumerate(PAGES)], "page_id long, url string, html string, text string, row long")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert html.extract(pages.limit(0)).count() == 0


def test_host_boilerplate_goes_and_copies_stay(spark):
    bar = "<div>all about our very great site and its offers today</div>"
    story = [prose(random.Random(i), 30) for i in range(6)]
    page = lambda i: f"{bar}<p>{story[i]}</p>"
    rows = [(i, "http://s.org/a", page(i)) for i in range(6)] + [(10, "http://t.org/", page(1)), (11, "http://s.org/c", page(1)), (12, None, page(2))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == story
    assert got[11] == got[1] and got[10].startswith("all about") and got[12].startswith("all about")


def brute_extract(pages, run=5, covered=0.5, share=0.5):
    """The same decisions by comparing every page with every other one: {page_id: text}."""
    cut = {i: [b for b in html.parse(h) if b[0] != "furniture"] for i, _, h in pages}
    said = {i: tuple(t for _, t in b) for i, b in cut.items()}
    host = {i: (u or "").split("/")[2] if "://" in (u or "") else "" for i, u, _ in pages}
    words = {i: [w for z, t in b if z != "main" for w in t.split(" ")] for i, b in cut.items()}
    out = {}
    for i, blocks in cut.items():
        others = {said[j]: j for j in cut if host[j] == host[i] and said[j] != said[i]}
        grams = {tuple(words[j][k : k + run]) for j in others.values() for k in range(len(words[j]) - run + 1)}
        hit = [False] * len(words[i])
        for k in range(len(hit) - run + 1):
            if tuple(words[i][k : k + run]) in grams:
                hit[k : k + run] = [True] * run
        mains = [[t for z, t in cut[j] if z == "main"] for j in others.values()]
        mine = [t for z, t in blocks if z == "main"]
        n = len(others) + 1
        lines = {t for t in mine if (c := 1 + sum(t in m for m in mains)) >= 3 and c >= share * n}
        if 2 * sum(len(t.split(" ")) for t in mine if t in lines) >= sum(len(t.split(" ")) for t in mine):
            lines = set()
        at, kept = 0, []
        for z, t in blocks:
            if z == "main":
                if t not in lines:
                    kept.append(t)
                continue
            m = len(t.split(" "))
            if sum(hit[at : at + m]) < covered * m and not (mine and n < 2):
                kept.append(t)
            at += m
        out[i] = "\n\n".join(kept)
    return out


def test_extract_like_brute_force(spark):
    """Pages with and without articles, lines that a site repeats in and beside them, copies, compound classes."""
    rng = random.Random(15)
    pool, rows = [prose(rng, rng.randint(2, 14)) for _ in range(25)], []
    sign = "<p>subscribe to this site today</p>"
    for i in range(160):
        body = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randint(1, 20))
            if rng.random() < 0.2:
                t = prose(rng, 3) + " " + t
            body.append(rng.choice([f"<p>{t}</p>", f"<div class='news-footer'>{t}</div>", f"<div>{t}</div>", f"<nav>{t}</nav>"]))
        if rng.random() < 0.8:
            body.insert(rng.randint(0, len(body)), f"<article class='no-sidebar'><p>{rng.choice(pool)}</p><p>{prose(rng, 25)}</p>{sign if rng.random() < 0.8 else ''}</article>")
        rows.append((i, rng.choice(["http://a.org/x", "http://a.org/y", "https://b.org", "http://c.org/", f"http://d{i}.org/"]), "".join(body)))
    rows += [(200 + i, u, h) for i, u, h in rows[:30]] + [(300, None, rows[3][2]), (301, "http://b.org/z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_extract(rows)
    for depth in (5, 8):
        got = {r.page_id: r.text for r in html.extract(df, depth=depth).collect()}
        assert got == want
    stated = {i for i, _, h in rows if "subscribe" in (h or "")}
    assert 0 < sum("subscribe" in want[i] for i in stated) < len(stated) / 2


def test_lines_of_a_site_leave_its_articles_and_copies_stay(spark):
    line = "<p>join our readers and get news by mail</p>"
    rows = [(i, "http://s.org/", f"<article><p>{prose(random.Random(i), 40)}</p>{line}</article>") for i in range(6)]
    same = "<article><p>" + prose(random.Random(77), 30) + "</p><p>{}</p></article>"
    rows += [(20 + i, "http://t.org/", same.format(f"edit {i}")) for i in range(5)]  # near copies are whole
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("readers" in got[i] for i in range(6)) and all(len(got[20 + i].split("\n\n")) == 2 for i in range(5))


def test_runs_that_a_site_sets_into_its_articles_go_beside_other_words(spark):
    line = "<p>{} asks you: join our readers and get news by mail</p>"  # never the same line
    rows = [(i, "http://s.org/", f"<article><p>{prose(random.Random(i), 40)}</p>{line.format(f'editor{i}')}<p>share this</p></article>") for i in range(8)]
    rows += [(20 + i, "http://t.org/", h) for i, (_, _, h) in enumerate(rows[:2])]  # two pages are no custom of a site
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [prose(random.Random(i), 40) for i in range(8)]
    assert all(len(got[20 + i].split("\n\n")) == 3 for i in range(2))


def brute_articles(pages, run=5, covered=0.5, share=0.5):
    """Texts of pages that are articles alone, every run of each page looked for on every other one."""
    cut = {i: [t for z, t in html.parse(h) if z == "main"] for i, _, h in pages}
    host = {i: (u or "").split("/")[2] if "://" in (u or "") else "" for i, u, _ in pages}
    out = {}
    for i, blocks in cut.items():
        others = {"\n".join(cut[j]) for j in cut if host[j] == host[i]}
        enough = max(3, share * len(others))
        has = lambda part, whole=False: sum(f"\n{part}\n" in f"\n{t}\n" if whole else f" {part} " in " " + t.replace("\n", " ") + " " for t in others) >= enough  # noqa: B023, E731
        words = " ".join(blocks).split()
        hit = [False] * len(words)
        for k in range(len(words) - run + 1):
            if has(" ".join(words[k : k + run])):
                hit[k : k + run] = [True] * run
        at, gone, size = 0, [], [len(t.split()) for t in blocks]
        for t, m in zip(blocks, size):
            gone.append(sum(hit[at : at + m]) >= covered * m or m < run and has(t, whole=True))
            at += m
        if 2 * sum(m for m, x in zip(size, gone) if x) >= sum(size):
            gone = [False] * len(gone)
        out[i] = "\n\n".join(t for t, x in zip(blocks, gone) if not x)
    return out


@pytest.mark.parametrize("depth", [5, 8])
@pytest.mark.parametrize("parts", [1, 16])
def test_article_runs_like_brute_force(spark, depth, parts):
    """Common runs whole, in part, across blocks and of few words; common words without a run; copies in all tasks."""
    rng = random.Random(33)
    signs = ["share this", "by", "all rights of this site reserved for ever", "read our terms", "sign up and get the news of the day by mail"]
    rows = []
    for i in range(150):
        body = [f"<p>{prose(rng, rng.randint(10, 30))} {' '.join(rng.sample(['of', 'the', 'and', 'this', 'our', 'day'], 4))}</p>" for _ in range(rng.randint(1, 3))]
        for t in signs:
            if rng.random() < 0.7:
                w = t.split()
                w = w[rng.choice([0, 0, 1]) :][: rng.choice([20, 6])]
                own = prose(rng, rng.choice([0, 0, 2, 9])).split()
                body.insert(rng.randint(0, len(body)), f"<p>{' '.join(own + w)}</p>" if w else "")
        rows.append((i, rng.choice(["http://a.org/x", "http://a.org/y", "http://b.org", f"http://c{i % 9}.org/"]), f"<article>{''.join(body)}</article>"))
    rows += [(1000 + 100 * i + k, "http://copies.org/", rows[i][2]) for i in range(12) for k in range(16)]
    want = brute_articles(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = {r.page_id: r.text for r in html.extract(df, depth=depth).collect()}
    assert got == want
    whole = brute_articles(rows, share=99)
    assert 20 < sum(want[i] != whole[i] for i in want) < len(want) - 20 and any(want[i] != whole[i] for i in want if i >= 1000)


def test_runs_of_a_copy_are_merged():
    """Else a row of each copy holds all its suffixes, and a table of few rows is too large to broadcast."""
    import pyarrow as pa

    runs = [{"i": i, "n": 5} for i in range(3000)] + [{"i": 3010, "n": 2}]
    kind = pa.list_(pa.struct([("i", pa.int64()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([runs, []], kind)], names=["row", "inner"])
    (out,) = html._merged([batch])
    assert out.to_pylist() == [{"row": 7, "inner": [{"i": 0, "n": 3004}, {"i": 3010, "n": 2}]}, {"row": 8, "inner": []}]


def test_a_run_that_every_task_sees_seldom_goes(spark):
    """Copies of pages without it are in all tasks, so on each it stands on a quarter of the pages, of all on more than half."""
    page = lambda i, more="": f"<article><p>{prose(random.Random(i), 40)}</p>{more}</article>"
    rows = []
    for part in range(4):
        rows += [(10 * part + i, "http://s.org/", page(i)) for i in range(6)]
        rows += [(10 * part + i, "http://s.org/", page(100 + 2 * part + i, "<p>join our readers and get news by mail</p>")) for i in (6, 7)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task for each file
    try:
        got = {r.page_id: r.text for r in html.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 32 and all("\n\n" not in t and "readers" not in t for t in got.values())


def test_words_of_a_class_do_not_take_an_article():
    assert html.parse('<article class="post no-sidebar"><p>real text</p></article>') == [("main", "real text")]
    assert html.parse('<div class="with-comments">real</div>') == [("suspect", "real")]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"'>" * 170_000, "<div>" * 100_000 + "</x>" * 100_000, "<a '>" + '<a ">' * 200_001, "<!--" * 250_000, "<!x " * 250_000, "<" * 1_000_000, "<script>" * 120_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.time()
    html.parse(page)
    assert time.time() - began < 2


# -- 5 --------------------------------------------------------------------------------
def brute_leaks(docs, items, width=5, threshold=0.8):
    def sh(t):
        w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    out = set()
    for d, t in docs:
        have = sh(t)
        for i, u in items:
            need = sh(u)
            if d is not None and need and len(need & have) >= threshold * len(need) - 1e-9:
                out.add((d, i, len(need), len(need & have)))
    return out


def test_leaks_like_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([3, 5, 6, 15, 40]))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(120):
        w = prose(rng, rng.choice([0, 4, 50, 400])).split()
        t = rng.choice(items)[1] or ""
        part = t.split()
        if part and d % 3 == 0:
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + part + w[at:]
        docs.append((d, " ".join(w).upper()))
    docs += [(None, items[4][1]), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name in ("h", "doc_id", "need", "r", "hs", "shingle", "n_shingles", "run"):
        bench = bench.withColumn(name, F.lit(1))
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in contamination.leaked_items(docs_of(spark, docs), bench).collect()}
    assert got == brute_leaks(docs, items)
    assert contamination.leaked_items(docs_of(spark, []), bench).count() == 0
    assert contamination.leaked_items(docs_of(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_is_native(spark):
    plan = queries.op5_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# -- 6 --------------------------------------------------------------------------------
def test_nearest_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROW_BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[100:140] = x[3]  # ties
    x[7] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] * 8), (None, [1.0] * 8), (460, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("d", F.lit("x"))
    got = nearest.nearest(df, every=20, k=20).collect()
    live = np.array([i for i in range(300) if i != 7])
    for q in range(0, 300, 20):
        others = live[live != q]
        s = nearest.exact(np.broadcast_to(x[q].astype(float), (len(others), 8)), x[others].astype(float))
        want = [(int(others[k]), float(s[k])) for k in np.lexsort((others, -s))[:20]]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert nearest.nearest(df.limit(0)).count() == 0
    assert nearest.nearest(df.where("vec_id in (0, 1)")).count() == 1


def test_nearest_of_repeated_ids_long_vectors_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROW_BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4096)) * np.exp(rng.normal(size=(90, 1)) * 3)
    rows = [(int(i % 60), [float(v) for v in r]) for i, r in enumerate(x)] + [(100, [1e200, -1e200]), (101, [1e200, 1e200]), (102, [3.0, 4.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), every=20, k=20).collect()
    for q in (0, 20, 40):
        mine = next(v for i, v in rows if i == q)
        others = [(i, np.array(v)) for i, v in rows if i != q and len(v) == 4096]
        score = nearest.exact(np.broadcast_to(mine, (len(others), 4096)), np.array([v for _, v in others]))
        want = sorted(((-s, i) for s, (i, _) in zip(score, others)))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.vec_id for r in got if r.query_id == 100} == {101, 102}


# -- 7 --------------------------------------------------------------------------------
def test_urls(spark):
    canon = "<link rel='canonical' href='{}'>".format
    rows = [
        (1, "http://a.NET/x", None), (2, "https://example.net/en/1#top", ""), (3, "http://x.example.com/de/1?q", "x"), (4, "http://fr.org/fr/", None), (5, "http://z.org/", canon("http://bad.net/p")), (6, None, None), (7, "nothing", ""),
        (8, "http://net", None), (9, "http://y.org/2", '<META http-equiv="refresh" content="0; url=/t">'), (10, "http://y.org/t", canon("https://q.example.com/de/x")), (11, "http://k.org/1", canon("http://m.net/")), (12, "http://k.org/2", canon("http://k.org/1")),
        (13, "http://example.net/en/9", canon("http://k.org/2")), (1, "http://a.NET/x", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit("n")).withColumn("host", F.lit("h"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, queries.URL_RULES).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3] == ("x.example.com", "/de/1", "example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][2:] == (None, "block") and got[6] == got[7] == ("", "", None, "allow") and got[8] == ("net", "", None, "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "block")
    assert got[11][2:] == got[12][2:] == (None, "allow")  # an alias is allowed by name, which precedes the blocked one
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert urls.judge_urls(df, queries.URL_RULES).count() == len(rows)
    more = spark.createDataFrame([("http://fr2.org/a", "http://w.net/b")], "src string, dst string")
    page = spark.createDataFrame([(1, "https://fr2.org/a#x", None)], "page_id long, url string, html string")
    assert urls.judge_urls(page, queries.URL_RULES, redirects=more).first().verdict == "block"


def test_url_filters_are_native_and_take_long_urls(spark):
    plan = queries.op7_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    long_ = "http://" + "a." * 20_000 + "net/" + "p/" * 20_000 + "?" + "q" * 20_000
    df = spark.createDataFrame([(1, long_, "<link rel=canonical href='http://x.org/" + "y" * 20_000 + "'>" + "<p>" * 50_000), (2, "http://x.org/" + "y" * 20_000, "")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, queries.URL_RULES).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "block")}


# -- 8 and 9 ----------------------------------------------------------------------------
def labelled(spark, bad, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        rows.append((i, bad(prose(rng, rng.randint(30, 80)), y, rng)))
        labels.append((i, y))
    return rows, spark.createDataFrame(labels, "doc_id long, y int")


def held_accuracy(out, labels):
    want = {r.doc_id: r.y for r in labels.collect()}
    held = [r for r in out if r.held_out]
    assert all(0 <= r.score <= 1 for r in out) and {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    return sum(r.predicted == want[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    rows, labels = labelled(spark, lambda t, y, rng: t + (" vile" + rng.choice(WORDS[:3]) + " " + prose(rng, 3) if y else ""), 700)
    out = toxicity.score_toxicity(docs_of(spark, rows), labels, label="y").collect()
    assert held_accuracy(out, labels) >= 0.9


def test_quality_held_out(spark):
    rows, labels = labelled(spark, lambda t, y, rng: t if y else t[:40] + " ".join(w + "###" for w in t[40:].split()))
    out = quality.score_quality(docs_of(spark, rows), labels, label="y").collect()
    assert held_accuracy(out, labels) >= 0.9


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_odd_rows(spark, score):
    none = spark.createDataFrame([], "doc_id long, y int")
    out = score(docs_of(spark, ODD), none, label="y").collect()
    assert len(out) == len(ODD) and {r.score for r in out} == {0.0} and [r.held_out for r in out if r.doc_id is None] == [False]
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (6, None), (4, 0)], "doc_id long, y int")
    assert len(score(docs_of(spark, ODD), some, label="y").collect()) == len(ODD)
    assert score(docs_of(spark, []), some, label="y").count() == 0


def test_text_network_like_its_definition(monkeypatch):
    """Every window of every filter by loops, over block ends too."""
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    rng = np.random.default_rng(9)
    cols, total = sum(toxicity.WIDTHS) * toxicity.FILTERS, len(toxicity.WIDTHS) * toxicity.FILTERS
    p = {"words": rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), "stems": rng.normal(size=(toxicity.STEMS, toxicity.DIM)), "filters": rng.normal(size=(toxicity.DIM, cols)), "shift": rng.normal(size=total), "out": rng.normal(size=total), "bias": rng.normal(size=1)}
    net = toxicity.TextNet(p)
    for n in (0, 1, 2, 3, 6, 7, 8, 20, 50):
        text = " ".join(WORDS[i % len(WORDS)] + "äB"[i % 3 : 1] for i in rng.integers(0, 99, n)).encode()
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        e = [p["words"][zlib.crc32(w) % toxicity.BUCKETS] + p["stems"][zlib.crc32(w[: toxicity.STEM], 1) % toxicity.STEMS] for w in words]
        z, c = p["bias"][0], 0
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(e[t + j] @ p["filters"][:, c + j * toxicity.FILTERS + f] for j in range(w)) for t in range(len(e) - w + 1)]
                z += p["out"][k * toxicity.FILTERS + f] * max([0.0, *(v + p["shift"][k * toxicity.FILTERS + f] for v in sums)])
            c += w * toxicity.FILTERS
        assert abs(net.logit(toxicity.word_ids(text, toxicity.Ids())) - z) < 1e-3


def test_byte_network_like_its_definition():
    rng = np.random.default_rng(10)
    F_, W, D = quality.FILTERS, quality.WIDTH, quality.DIM
    p = {"bytes": rng.normal(size=(256, D)), "filters": rng.normal(size=(W * D, F_)), "shift": rng.normal(size=F_), "mean": rng.normal(size=F_), "most": rng.normal(size=F_), "bias": rng.normal(size=1)}
    net = quality.ByteNet(p)
    for n in (0, 5, 500, 1200):
        text = bytes(rng.integers(1, 256, n).tolist())
        count = max(1, -(-(n - (quality.CHUNK - quality.STEP)) // quality.STEP))
        padded = text + bytes(quality.CHUNK * 2)
        tops = []
        for k in range(count):
            c = padded[k * quality.STEP : k * quality.STEP + quality.CHUNK]
            tops.append([max(0.0, max(sum(p["bytes"][c[t + j]] @ p["filters"][j * D : (j + 1) * D, f] for j in range(W)) for t in range(0, quality.CHUNK - W + 1, 2)) + p["shift"][f]) for f in range(F_)])
        m = np.array(tops)
        z = m.mean(axis=0) @ p["mean"] + m.max(axis=0) @ p["most"] + p["bias"][0]
        assert abs(net.logit(text) - z) < 1e-6


def test_long_labelled_texts_teach_too(spark):
    from leafline.llm.training import labelled_sample

    rows = [(i, "word " * (20_000 if i == 7 else 5)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, y int")
    sample, _ = labelled_sample(docs_of(spark, rows), labels, "y")
    assert max(len(t) for t, _, _ in sample) == (100_000 if zlib.crc32(b"7") % 5 else 25) and len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    assert sum(len(t) for t, _, _ in labelled_sample(docs_of(spark, rows), labels, "y", size=100)[0]) <= 100
    assert len(labelled_sample(docs_of(spark, rows), labels, "y", rows=6)[0]) <= 6


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(spark, lambda t, y, rng: t + (" vile" if y else ""), 200)
    turned = labels.withColumn("y", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    df = docs_of(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(df, x, label="y").collect()} for x in (labels, turned))
    assert a == b


def test_chunks_cover_everything():
    for n in (0, 1, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, 5000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        c = quality.chunks(text)
        joined = b"".join(bytes(r[: quality.STEP]) for r in c[:-1]) + bytes(c[-1])
        assert joined[:n] == text and not any(joined[n:])


# -- 10 -------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", (["mit"], [])), ("(Apache-2.0 OR MIT) prose follows", (["apache-2.0", "mit"], [])), ("GPL-2.0 with X-exception", (["gpl-2.0"], ["x-exception"])),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR (MIT AND BSD-3-Clause) and more", (["gpl-2.0-only", "mit", "bsd-3-clause"], ["classpath-exception-2.0"])),
        ("AND MIT", None), ("(MIT", None), ("", None), ("MIT OR", None), ("MIT OR ISC WITH LLVM-exception AND Zlib", (["mit", "isc", "zlib"], ["llvm-exception"])), ("(MIT OR ISC) WITH LLVM-exception", None),
        ("MIT and see the file", (["mit"], [])), ("see LICENSE", None), ("MIT, and others", (["mit"], [])), ("MIT with changes", (["mit"], [])), ("MIT OR see", None), ("LicenseRef-mine-1 or GPL-3.0-or-later", (["licenseref-mine-1", "gpl-3.0-or-later"], [])),
        ("LGPL-2.1+ and MIT)", (["lgpl-2.1+", "mit"], [])), ("MIT Apache-2.0", (["mit"], [])), ("LLVM-exception", None), ("((MIT))", (["mit"], [])), ("()", None),
    ],
)
def test_expressions(text, want):
    assert licences.parse_expression(text) == want


@pytest.mark.parametrize("seed", range(20))
def test_expressions_like_a_recursive_parser(seed):
    """Random expressions, built as trees and written out, name what the trees hold."""
    rng, ids = random.Random(seed), ["MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "BSD-3-Clause", "Zlib", "CC-BY-4.0"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(ids)
            return (f"{name} WITH LLVM-exception", [name.lower()], ["llvm-exception"]) if rng.random() < 0.3 else (name, [name.lower()], [])
        a, b = tree(depth - 1), tree(depth - 1)
        text = f"{a[0]} {rng.choice(['AND', 'or', 'OR', 'and'])} {b[0]}"
        return (f"({text})" if rng.random() < 0.5 else text, a[1] + b[1], a[2] + b[2])

    for _ in range(50):
        text, names, extra = tree(4)
        assert licences.parse_expression(text + rng.choice(["", " and so on", " the end", ""])) == (names, extra)


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(k, licences.BASE[p]) for p in licences.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licences_like_brute_force(spark):
    rng = random.Random(9)
    bits = ["CC BY", "cc", "by", "General  Public License", "all rights", "All-Rights-Reserved.", "reserved", "é", "x1", "SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "lesser general public license"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)] + ODD
    got = sorted(((r.doc_id or -1, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licences.scan_licences(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted(((i or -1, brute_licence(t)) for i, t in rows), key=repr)
    prose_labels = {t: licences.scan(t, licences.automaton()) for t in ("SPDX-License-Identifier: see LICENSE", "SPDX-License-Identifier: MIT and see the file")}
    assert [(x["labels"], x["score"]) for x in prose_labels.values()] == [("", 0.0), ("mit", 1.0)]
    one = licences.scan_licences(docs_of(spark, [(1, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncc by")])).first()
    assert one.labels == "apache-2.0,cc-by,mit" and one.score == 1.0 and one.base_labels == "cc-by"
    assert licences.scan_licences(docs_of(spark, [])).count() == 0


def test_language_by_the_whole_text():
    """A text that opens in English and is mostly French is French."""
    ids = toxicity.word_ids(b"the of and " * 360_000 + b"le les des " * 700_000, toxicity.Ids())
    assert toxicity.language_of(ids, toxicity.function_ids()) == "fr"

# -- pipeline ---------------------------------------------------------------------------
def test_pipeline(spark):
    """Each stage on what its predecessor kept, against brute force."""
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    docs = c.load(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.score_toxicity(docs, c.load(spark, SF, "labels")).collect()
    kept = common.staged(stages["toxicity"](spark, docs, SF))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores if r.score < 0.5}

    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    one = common.staged(stages["simhash_near_dedup"](spark, kept, SF))
    lower = [(i, t.translate({k: k + 32 for k in range(65, 91)})) for i, t in rows]
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in lower)}
    group = brute_components(sorted(sets.items()), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(group.values())

    items = [(r.item_id, r.text) for r in c.load(spark, SF, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in one.collect()]
    clean = common.staged(stages["benchmark_decontamination"](spark, one, SF))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {x[0] for x in brute_leaks(rows, items)}

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    private = common.staged(stages["pii"](spark, clean, SF))
    terms = {}
    for i, _, a, b in brute_terms(rows):
        terms.setdefault(i, set()).add((a, b))
    assert private.columns == docs.columns and private.count() == len(rows)
    for r in private.collect():
        spans = [(s, e) for _, s, e in brute_spans(text[r.doc_id] or "")]
        hidden = sorted({*spans, *terms.get(r.doc_id, ())})
        left = "".join(x for k, x in enumerate(text[r.doc_id] or "") if not any(s <= k < e for s, e in hidden))
        assert re.sub(r"\[(?:EMAIL|IP|CARD|PHONE|TERM)\]", "", r.text or "") == left

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    size = {r.doc_id: len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in private.collect()}
    got, held = stages["best_fit_packing"](spark, private, SF).collect(), {}
    for r in got:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == size


def test_dedup_stage_keeps_one_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(10)
    t = prose(rng, 80)
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (3, prose(rng, 80)), (None, t), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in c.near_dedup(spark, docs, SF).collect()) == [-1, 1, 3, 4]
    other = prose(rng, 70)
    docs = spark.createDataFrame([(1, t, 7), (1, other, 8), (2, t + " more", 9), (1, other, 8)], "doc_id long, text string, component long")
    got = [(r.doc_id, r.text) for r in c.near_dedup(spark, docs, SF).collect()]
    assert sorted(got) == sorted([(1, t), (1, other)])  # different texts of one id are different documents


@pytest.mark.parametrize("k", range(4))
def test_filtering_stages_on_odd_rows(spark, k):
    import corpus_pipeline as c

    df = docs_of(spark, ODD)
    out = c.STAGES[k][1](spark, df, SF)
    assert out.columns == df.columns
    got = out.collect()
    assert {r.doc_id for r in got} == ({None, 1, 3, 4, 5} if k == 1 else {i for i, _ in ODD}) and (len(got) == len(ODD) or k == 1)
    none = c.STAGES[k][1](spark, docs_of(spark, []), SF)
    assert none.columns == df.columns and none.count() == 0


def test_queries_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
