"""Small cases of every operator against brute force, with nulls, empty texts, repeats and clashing columns."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidframe.llm import (decontaminate as dc, embedding_dedup as ed, jaccard_join as jj, mixing, pii, quality,
                          secrets, substring_dedup as sd, toxicity, url_filter as uf)
from bidframe.llm.common import components, group, numbered

DOCS = "doc_id bigint, text string, source string, v double, taken int"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, (sources or ["a"] * len(texts))[i], 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


# --- common -------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = group(60, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = {n: int(root[n]) for e in edges for n in e if e[0] != e[1]}
    frame = spark.createDataFrame([*edges, (None, 3), (7, 7)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(frame).collect()} == want
    assert components(frame.where("u > 1000")).count() == 0


def test_numbered_orders_all_rows(spark):
    frame = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    assert rows(numbered(frame, [F.desc("x")], "n"), "x", "n") == [(x, 99 - x) for x in range(100)]
    assert numbered(frame.where("x < 0"), [F.col("x")], "n").count() == 0


# --- 1 personal data ----------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_brute(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and sum(sum(divmod(x, 10)) for x in doubled) % 10 == 0,
                    "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_equals_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@..1234+( )-%0\n") for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == pii_brute(text)
    assert pii.base_spans("a" * 200_000 + "1" * 50_000) == []
    assert pii.base_spans("4111 1111 1111 1111 x 4111-1111-1111-1112") == [("card", 0, 19)]


def test_pii_find_and_redact(spark):
    rng = random.Random(3)
    texts = [None, "", "é mail a.b@c.de now"]
    for i in range(120):
        texts.append(f"{prose(rng, 8)} call +1 (2{i % 90 + 10}) 555-{1000 + i} or x{i}@m{i}.example.com host 10.0.{i}.7 "
                     f"4111111111111111 and 7{rng.randrange(10 ** 15, 10 ** 16 - 1)}")
    docs = docs_of(spark, texts)
    finder = pii.train(docs)
    assert set(finder.trees) and set(finder.trees) <= set(pii.KINDS)
    for r in pii.find(docs, finder).collect():
        base = [tuple(x) for x in r.base]
        assert base == pii_brute(texts[r.doc_id] or "") and set(base) <= {tuple(x) for x in r.spans}
    out = {r.doc_id: r for r in pii.redact(docs, finder).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == "é mail [EMAIL] now"
    assert not any("@m" in (r.text or "") for r in out.values())
    assert pii.find(docs.where("false"), pii.train(docs.where("false"))).count() == 0


def test_pii_adds_spelled_out_addresses(spark):
    rng = random.Random(4)
    texts = [f"{prose(rng, 6)} mail user{i}@mail{i}.example.com {prose(rng, 5)}" for i in range(200)]
    finder = pii.train(docs_of(spark, texts))
    assert [k for k, _, _ in finder.spans("write to jane.roe (at) mail7.example.com today")] == ["email"]
    assert finder.spans(prose(rng, 50)) == []


# --- 2 urls -------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.ORG/es/1?x#y", "http://a.example.org/en/17", "http://b.org?q", "https://c.com/fr/x",
            "x://c.com/de/", "http://com.net/fr/", None, "no url", "http://xcom/fr/", "s://http://a.com/fr/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    host, path = uf.host_path(F.col("url"))
    rule, verdict = uf.rule_of(host, path)
    got = rows(frame.select("page_id", host.alias("h"), path.alias("p"), rule.alias("r"), verdict.alias("v")), "*")
    assert got == [(0, "www.example.org", "/es/1", "example.org/es/", "block"), (1, "a.example.org", "/en/17", "example.org/en/1", "block"),
                   (2, "b.org", "", None, None), (3, "c.com", "/fr/x", "com/fr/", "allow"), (4, "c.com", "/de/", "com/de/", "block"),
                   (5, "com.net", "/fr/", None, None), (6, "", "", None, None), (7, "", "", None, None),
                   (8, "xcom", "/fr/", None, None), (9, "http:", "//a.com/fr/", None, None)]


def test_url_judge(spark):
    pages = spark.createDataFrame(
        [(i, f"http://cheappills{i % 3}.com/de/{i}", "<p>cheap pills cheap pills</p>") for i in range(20)]
        + [(100 + i, f"http://goodnews.org/x{i}", "<b>good news</b> good news") for i in range(20)]
        + [(200, "http://cheappills.net/de/4", ""), (201, "http://goodnews.net/x1", None), (202, None, None)],
        "page_id bigint, url string, html string")
    got = {r.page_id: r for r in uf.judge(pages, pages.select(F.col("html").alias("text"))).collect()}
    assert len(got) == 43 and got[200].words == ["cheap", "pills", "net"] and got[201].words == ["good", "news", "net"]
    assert (got[200].verdict, got[201].verdict, got[202].host) == ("block", "allow", "")
    assert uf.judge(pages.where("false"), pages.select(F.col("html").alias("text"))).count() == 0


def test_segment_prefers_known_words():
    known = {w: -5.0 for w in ("cheap", "pills", "now")}
    assert uf.segment("cheappillsnow", known, 1e6) == ["cheap", "pills", "now"]
    assert uf.segment("", known, 1e6) == []


# --- 3 decontamination --------------------------------------------------------------


def edit_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_align_equals_dynamic_programme():
    rng = random.Random(5)
    for _ in range(300):
        p, t = (np.array([rng.choice([97, 98, 99]) for _ in range(rng.randint(1, n))], np.uint32) for n in (12, 25))
        want, budget = edit_distance(p, t), rng.randint(0, 5)
        got = dc.align(p, t, budget)
        assert (got is None) == (want > budget) and (got is None or got[0] == want)


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (5, 9, 40, 70, 130, 200)]
    texts = [None, "", prose(rng, 50)]
    for item in items:
        for edits in (0, 2, 4, 12):
            chars = list(item)
            for _ in range(min(edits, len(chars) // 4)):
                chars[rng.randrange(len(chars))] = rng.choice(["", "z", "ab"])
            texts.append(f"{prose(rng, 30)} {' '.join(chars).upper() if edits else item} {prose(rng, 30)}")
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id bigint, text string")
    want = set()
    for i, text in enumerate(texts):
        codes, _ = dc.letters(text or "")
        for j, item in enumerate(items):
            for _, p in dc.windows(item):
                if edit_distance(p, codes) <= dc.budget(len(p)):
                    want.add((i, j))
    docs = docs_of(spark, texts)
    got = dc.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {r.doc_id for r in dc.keep_uncontaminated(docs, bench).collect()} == {*range(len(texts))} - {i for i, _ in want}
    assert dc.contaminated(docs, bench.where("false")).count() == 0


# --- 4 quality ----------------------------------------------------------------------


def test_quality_held_out(spark):
    rng = random.Random(7)
    texts = [prose(rng, 60) if i % 3 else " ".join(f"W{rng.randrange(5)}!!" for _ in range(60)) for i in range(300)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert 40 < len(held) < 110 and all(got[i].predicted == (i % 3 > 0) for i in held)
    assert quality.score(docs.where("false"), quality.train(docs, labels.where("false"))).count() == 0


# --- 5 Jaccard join -----------------------------------------------------------------


def jaccard_brute(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_similar_documents(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jj, "SMALL_REGION", 6)
    monkeypatch.setattr(jj, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    texts = [None, "", " \n", "A b", "a B", "a b c d", "one", "x\x1fy z"]
    for _ in range(6):
        base = prose(rng, rng.choice([12, 40, 120])).split()
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 20))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words) + rng.choice(["", " tail", " Some words more"]))
    docs = docs_of(spark, texts)
    assert rows(jj.similar_documents(docs, k, percent), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, k, percent)
    kept = {r.doc_id for r in jj.one_of_each(docs, k, percent).collect()}
    assert kept == {c for _, _, c in jaccard_brute(texts, k, percent)}


def test_similar_documents_edges(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "A B C D E")], "doc_id bigint, text string")
    got = sorted(jj.similar_documents(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (None, 2, None)]
    assert jj.similar_documents(frame.where("false")).count() == 0


@pytest.mark.parametrize("k, percent", [(2, 85), (3, 60), (1, 80)])
def test_large_open_regions_send_windows_first(spark, monkeypatch, k, percent):
    """Regions of three members already meet in blocks of two; every link is still found."""
    monkeypatch.setattr(jj, "SMALL_REGION", 2)
    monkeypatch.setattr(jj, "BLOCK_ROWS", 2)
    rng = random.Random(percent)
    texts = []
    for _ in range(14):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 40))]
        for _ in range(4):
            texts.append(" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(50)}" for w in base))
    docs = docs_of(spark, texts)
    assert rows(jj.similar_documents(docs, k, percent), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, k, percent)


def test_windows_of_similar_sets_share_what_is_needed():
    rng, close = random.Random(5), 0
    for percent in (60, 85, 90):
        for _ in range(400):
            one = set(rng.sample(range(400), rng.randrange(1, 90)))
            other = {x for x in one if rng.random() > 0.06} | set(rng.sample(range(400), rng.randrange(4)))
            if not other or 100 * len(one & other) < percent * len(one | other):
                continue
            window = lambda x: sorted(x)[:len(x) - jj.unseen(len(x), percent)]
            if one != other:
                close += 1
                assert len(set(window(one)) & set(window(other))) >= jj.needed(len(one), len(other), percent)
    assert close > 300


def test_only_members_with_a_possible_partner_send_their_sets():
    """A hundred texts of a region that share a few rare shingles only; two are alike."""
    rng = random.Random(8)
    members = [(i, i, 100, np.sort(np.array([*range(5), *rng.sample(range(10, 10**6), 13)]))) for i in range(100)]
    twin = members[7][3].copy()
    members.append((500, 500, 100, twin))
    assert [r[0] for r in jj.able_members(members, None, 85)] == [7, 500]
    assert [r[0] for r in jj.able_members(members[:50], members[50:], 85)] == [7, 500]
    assert jj.able_members([(a, 1, n, w) for a, _, n, w in members], None, 85) == []


# --- 6 substrings -------------------------------------------------------------------


def test_repeated_units(spark):
    long, two = " ".join(["word"] * 60), " ".join(["half"] * 30)
    texts = [f"start\n{long}\nshort line\nend", f"x1\n  {long.upper()}  \nshort line\ny", f"{two}\n\n{two} b\nq", f"z\n{two}\n{two} b", None, ""]
    docs = docs_of(spark, texts)
    got = sd.repeated_units(docs)
    found = {(r.doc_id, texts[r.doc_id][r.start:r.stop].strip(), r.kept_doc_id) for r in got.collect()}
    # "short line" follows the passage, so it goes with it.
    assert found == {(1, long.upper(), 0), (1, "short line", 0), (3, two, 2), (3, f"{two} b", 2)}
    every = {(r.doc_id, r.unit) for r in sd.repeated_units(docs, min_words=1).collect()}
    assert every == {(1, 1), (1, 2), (3, 1), (3, 2)}
    left = {r.doc_id: r.text for r in sd.remove_units(docs, got).collect()}
    assert left[1] == "x1\ny" and left[3] == "z\n" and left[0] == texts[0] and left[4] is None
    assert sd.repeated_units(docs.where("false")).count() == 0


def test_repeated_passages_wherever_they_begin(spark):
    rng = random.Random(6)
    shared, size = [prose(rng, n, 10_000) for n in (50, 55, 70)], 50
    join = lambda *parts: " ".join(parts)
    texts = [join(prose(rng, 9), shared[0], prose(rng, 8)), join(prose(rng, 5), shared[0].upper().replace(" ", "\n "), prose(rng, 7)),
             join(prose(rng, 3), shared[1], shared[2], prose(rng, 3)), join(shared[2], prose(rng, 4), shared[1]),
             " ".join(["junk"] * 130), join(prose(rng, 4), prose(random.Random(7), 49)), prose(random.Random(7), 49), None, ""]
    docs = docs_of(spark, texts)
    want, seen = set(), {}
    for doc, text in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"\S+", text or "")]
        words = (text or "").lower().split()
        for at in range(len(words) - size + 1):
            kept = seen.setdefault(tuple(words[at: at + size]), (doc, at))
            if kept != (doc, at) and (kept[0] != doc or at >= kept[1] + size):
                want |= {(doc, i) for i in range(spans[at][0], spans[at + size - 1][1])}
    got = sd.repeated_passages(docs)
    assert {(r.doc_id, i) for r in got.collect() for i in range(r.start, r.stop)} == want and want
    assert {r.doc_id for r in got.collect()} == {1, 3, 4}
    assert rows(got.where("doc_id in (1, 4)"), "doc_id", "words", "kept_doc_id") == [(1, 50, 0), (4, 80, 4)]
    left = {r.doc_id: r.text for r in sd.remove_units(docs, sd.repeated(docs)).collect()}
    assert left[4].split() == ["junk"] * 50 and len(left[1].split()) == 12 and len(left[3].split()) == 4
    assert sd.repeated_passages(docs.where("false")).count() == 0


def test_short_repeated_units_go(spark):
    docs = docs_of(spark, ["one short line\na", "b\none short line\nc"])
    assert rows(sd.repeated(docs), "doc_id", "unit", "kept_doc_id") == [(1, 1, 0)]


# --- 7 toxicity ---------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["vile", "awful", "nasty"]
    texts = []
    for i in range(400):
        words = prose(rng, 60).split()
        for _ in range(i % 4 and 0 or 1 + i % 7):
            words.insert(rng.randrange(len(words)), rng.choice(bad) if i % 4 == 0 else "kind")
        texts.append(" ".join(words))
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    right = sum(got[i].toxic == (i % 4 == 0) for i in range(300, 400))
    assert right >= 98 and 0 <= got[400].expected_severity <= 3 and not got[401].toxic
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, r in got.items() if not r.toxic}
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.grade(docs, none).where("toxic").count() == 0


# --- 8 mixing -----------------------------------------------------------------------


def test_water_fill_and_takes(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(60)] + [None, ""]
    sources = [rng.choice(["big", "b", "c", None]) if i > 3 else "tiny" for i in range(62)]
    docs = docs_of(spark, texts, sources)
    got = mixing.mix(docs, mixing.cycle_weights(docs)).collect()
    size = Counter()
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        target = 3.0 * size[s] if s in capped else weight[s] * level
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1
    again = mixing.mix(docs, mixing.cycle_weights(docs)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.repeat(docs, mixing.cycle_weights(docs))
    assert mixed.columns == [*docs.columns, "repetition"]
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
    assert taken == Counter({r.doc_id: r.taken for r in got if r.taken})
    assert mixing.mix(docs.where("false"), mixing.cycle_weights(docs.where("false"))).count() == 0


# --- 9 embeddings -------------------------------------------------------------------


def test_near_duplicates(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[:10] + 0.05 * rng.normal(size=(10, 16))), *base[:5], *(2 * base[:3])]
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] * 16, []]
    data += [(1000 + i, v, "y") for i, v in enumerate(odd)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, place string")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = group(len(vectors), *np.nonzero(link))
    want = [(i, int(link[i].sum()), int(root[i]), root[i] == i) for i in range(len(vectors))]
    want += [(1000 + i, 0, 1000 + i, True) for i in range(len(odd))]
    for block in (4, 4096):
        got = ed.near_duplicates(frame, block_rows=block)
        assert rows(got, "vec_id", "n_links", "component_id", "kept") == want
    assert ed.near_duplicates(frame.where("false")).count() == 0


def test_near_duplicates_of_each_length(spark):
    rng = np.random.default_rng(19)
    vectors = []
    for dims in (8, 5, 1):
        base = rng.normal(size=(12, dims))
        vectors += [*base, *(base[:4] + 0.05 * rng.normal(size=(4, dims))), *base[:3]]
    vectors = [[float(x) for x in v] for v in [*vectors, rng.normal(size=30)]]
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    link = np.array([[i != j and len(a) == len(b) and a @ b >= 0.95 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    root = group(len(unit), *np.nonzero(link))
    want = [(i, int(link[i].sum()), int(root[i]), root[i] == i) for i in range(len(unit))]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    for block in (4, 4096):
        assert rows(ed.near_duplicates(frame, block_rows=block), "vec_id", "n_links", "component_id", "kept") == want


def test_near_duplicates_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    """Many blocks, sent out a few vectors at a time: the same rows, and no vector is dealt out to the others."""
    rng = np.random.default_rng(23)
    base = rng.normal(size=(300, 24))
    vectors = [[float(x) for x in v] for v in [*base, *(base[:60] + 0.02 * rng.normal(size=(60, 24))), *base[:40]]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    want = rows(ed.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept")
    plans, plain = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, *a, **k: (
        plans.append(self._jdf.queryExecution().executedPlan().toString()), plain(self, *a, **k))[1])
    got = rows(ed.near_duplicates(frame, block_rows=8, chunk_bytes=5_000), "vec_id", "n_links", "component_id", "kept")
    assert got == want and sum(n for _, n, _, _ in want) >= 200
    assert len(plans) > 10 and not any("partitioning(" in p for p in plans if "Broadcast" not in p)


# --- 10 secrets ---------------------------------------------------------------------

SECRETS = {"assign": r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
           "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def secrets_brute(text):
    out = []
    for n, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= (12, 18, 16)[n]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets_base_equals_patterns():
    rng = random.Random(12)
    pieces = ["token", "Pass", "word", "passwd", "=", ": ", "'", '"', "AKIA", "ABCD1234", "deadbeef", "0123", "zz", " ", "ſecret", "api_key", "APIKEY"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert secrets.base_spans(text) == secrets_brute(text)


def test_secrets_scan(spark):
    rng = random.Random(13)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(150)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(150)]
    texts = [f"{prose(rng, 10)} token = \"{h}\" see file_name_{i}.txt and AKIA{k} Some-Long-Name{i}" for i, (h, k) in enumerate(zip(hexes, keys))]
    docs = docs_of(spark, [*texts, None, ""])
    scanner = secrets.train(docs)
    assert {"assign", "access", "hex"} == set(scanner.formats)
    for r in secrets.scan(docs, scanner).collect():
        base = [tuple(x) for x in r.base]
        assert base == secrets_brute([*texts, None, ""][r.doc_id] or "") and set(base) <= {tuple(x) for x in r.spans}
    assert secrets.scan(docs.where("false"), secrets.train(docs.where("false"))).count() == 0


def test_merging_ends_on_few_mixed_values():
    for seed in range(20):
        rng = random.Random(seed)
        paths = [secrets.symbols("".join(rng.choice("0a9fgZK+-_") for _ in range(rng.randrange(12, 70)))) for _ in range(rng.randrange(5, 150))]
        found = secrets.infer(paths)
        assert (found.step < len(found.step)).all() and np.isfinite(found.cost).all()


def test_secrets_learn_from_every_value(spark):
    """More values than the former limit of 3,000, and the same automata however the rows are dealt out."""
    rng = random.Random(15)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) + f" File-Name-{i}.txt" for i in range(3_400)]
    scanner = secrets.train(docs_of(spark, texts).repartition(3))
    assert scanner.seen == {"hex": 3_400, "ordinary": 3_400}
    again = secrets.train(docs_of(spark, texts + texts[:50]).repartition(7))
    assert scanner.thresholds == again.thresholds and scanner.thresholds["hex"] > 0
    assert all((a.step == b.step).all() and (a.cost == b.cost).all() for a, b in (
        (scanner.ordinary, again.ordinary), (scanner.formats["hex"], again.formats["hex"])))
    held = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    assert scanner.likelihood(held)["hex"] > scanner.thresholds["hex"] >= scanner.likelihood("File-Name-99999.txt")["hex"]


def test_inferred_automaton_prefers_its_format():
    rng = random.Random(14)
    own = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(200)]
    other = ["Word-" + "".join(rng.choice("ghijklmnop") for _ in range(19)) for _ in range(200)]
    a, b = secrets.infer([secrets.symbols(x) for x in own]), secrets.infer([secrets.symbols(x) for x in other])
    held = secrets.symbols("".join(rng.choice("0123456789abcdef") for _ in range(24)))
    assert a.log_likelihood(held) > b.log_likelihood(held) and len(a.step) < 60


def test_whole_prefixes_count():
    """What follows depends on the first character, far behind it; a length beyond 48 is known as well."""
    rng = random.Random(16)
    tail = {"7": "0123456789", "k": "ghijklmnop"}
    path = lambda first, last: secrets.symbols(first + "-_." * 2 + "".join(rng.choice(tail[last]) for _ in range(10)))
    found = secrets.infer([path(x, x) for x in "7k" * 100])
    for x, y in ("7k", "k7"):
        assert found.log_likelihood(path(x, x)) > found.log_likelihood(path(x, y)) + 5
    found = secrets.infer([secrets.symbols("".join(rng.choice("0123456789abcdef") for _ in range(60))) for _ in range(200)])
    held = secrets.symbols("0a" * 30)
    assert found.log_likelihood(held) > max(found.log_likelihood(held[:n]) for n in (49, 55, 59)) - 60 * np.log(6) + 5
    assert found.cost[:, secrets.END].max() > -0.01 and len(found.step) > 48


def test_merging_equals_merging_of_the_tree():
    """Against the prefix tree laid out with recursive comparison and folding."""
    def of_tree(paths, alpha=secrets.ALPHA):
        nodes = {}
        for p in paths:
            for i in range(len(p) + 1):
                nodes.setdefault(p[:i], np.zeros(9))[int(p[i]) if i < len(p) else secrets.END] += 1
        bound = np.sqrt(0.5 * np.log(2 / alpha))
        rest = {q: [len(p) - len(q) for p in paths if p.startswith(q)] for q in nodes}
        step = {q: {s: q + str(s) for s in range(8) if nodes[q][s]} for q in nodes}

        def alike(a, b):
            na, nb = nodes[a].sum(), nodes[b].sum()
            wide = bound * (na ** -0.5 + nb ** -0.5)
            return bool((np.abs(nodes[a] / na - nodes[b] / nb) < wide).all()) and all(
                alike(step[a][s], step[b][s]) for s in step[a].keys() & step[b].keys())

        def ends(a, b):
            share = lambda x, k: sum(i <= k for i in rest[x]) / len(rest[x])
            wide = bound * (len(rest[a]) ** -0.5 + len(rest[b]) ** -0.5)
            return all(abs(share(a, k) - share(b, k)) < wide for k in {*rest[a], *rest[b]})

        def fold(a, b):
            nodes[a] = nodes[a] + nodes[b]
            rest[a] = rest[a] + rest[b]
            for s, t in step[b].items():
                if s in step[a]:
                    fold(step[a][s], t)
                else:
                    step[a][s] = t

        red, at = [""], {}
        while blue := [(i, s) for i, r in enumerate(red) for s in sorted(step[r]) if (i, s) not in at]:
            i, s = blue[0]
            q = step[red[i]][s]
            to = next((j for j, r in enumerate(red) if ends(r, q) and alike(r, q)), None)
            if to is None:
                red.append(q)
                to = len(red) - 1
            else:
                step[red[i]][s] = red[to]
                fold(red[to], q)
            at[i, s] = to
        return [{s: at[i, s] for s in step[r]} for i, r in enumerate(red)], [nodes[r] for r in red]

    for seed in range(30):
        rng = random.Random(seed)
        shape = ["".join(rng.choice("013") for _ in range(rng.randrange(3, 7))) for _ in range(4)]
        paths = [rng.choice(shape) + rng.choice(("", "0", "11")) + "5" * rng.choice((2, 2, 6)) for _ in range(rng.randrange(5, 400))]
        found = secrets.infer([np.array([*map(int, p)]) for p in paths])
        step, counts = of_tree(paths)
        assert [{s: int(t) for s, t in enumerate(r) if t >= 0} for r in found.step] == step
        share = np.array([(c + 1e-4) / (c.sum() + 9e-4) for c in counts])
        share[:, :8] /= secrets._SIZES
        assert np.allclose(found.cost, np.log(share))


def test_digests(spark):
    from bidframe.llm.queries import _counted

    docs = docs_of(spark, ["AKIA" + "A1" * 8 + " token: abcdefabcdef1234", ""])
    got = {r.doc_id: r for r in _counted(secrets.scan(docs, secrets.Scanner({}, None, {})), secrets.KINDS).collect()}
    text = ",".join(f"{k}:{s}:{e}" for k, s, e in secrets_brute("AKIA" + "A1" * 8 + " token: abcdefabcdef1234"))
    assert got[0].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[0].spans == text
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and (got[0].n_access, got[0].n_assign, got[0].n_hex) == (1, 1, 1)
