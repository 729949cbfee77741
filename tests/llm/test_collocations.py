"""Collocations against brute force."""
import random
import re

import pytest

from bidframe.llm import collocations as co

LETTERS = {ord(c): ord(c) + 32 for c in map(chr, range(65, 91))}


def brute(rows, top=2000, most=5, min_count=5):
    f, n = {}, {}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LETTERS)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    f[key] = f.get(key, 0) + 1
    candidates = {key: a for key, a in f.items() if a >= min_count and len(key[1]) > 1}
    hidden = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = lang, w[i:i + k]
                if a >= f[part]:
                    hidden.add(part)
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in hidden:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode("utf-8", "surrogatepass"), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode("utf-8"), -a, left, right, n[lang], -s) for lang, rows in out.items()
            for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def found(spark, rows, min_count=5, **how):
    df = spark.createDataFrame([(i % 50 or None, t, lang, 1, "k") for i, (t, lang) in enumerate(rows)],
                               "doc_id long, text string, lang string, shard int, phrase string")
    return {tuple(r) for r in co.collocations(df, min_count=min_count, **how).collect()}


def corpus(seed, docs=150):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "a", "São", "PAULO", "Ä", "ä", "x1", "(y)", "\x00", "\x1c", " ", "-"]
    phrases = ["New York City hall Of", "são paulo", "the of the of the", "x1 (y) - Ä"]
    breaks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "?!", " ; "]
    out = []
    for _ in range(docs):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        out.append(("".join(p + rng.choice(breaks) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), ("...", "fr"), (" the of " * 3000, "en"), ("the of", "it")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = found(spark, rows)
    assert got == brute(rows) and got


def test_small_chunks_filters_and_tops(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", 300)
    rows = corpus(3)
    assert found(spark, rows, top=3, shard_count=3, min_count=7) == brute(rows, top=3, min_count=7)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "_holds", lambda bits, keys: keys == keys)
    rows = corpus(4, 60)
    assert found(spark, rows, shard_count=1) == brute(rows)


def test_shorter_phrases_and_empty_tables(spark):
    rows = corpus(5, 60)
    assert found(spark, rows, most=2) == brute(rows, most=2)
    assert found(spark, []) == set()
    assert found(spark, [("one two", "en")]) == set()


def test_scores_past_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 10 ** 15), ("en", "a", 1, 3 * 10 ** 15), ("en", "b", 1, 10 ** 15 + 7)],
                                    "lang string, phrase string, words int, f long")
    sizes = spark.createDataFrame([("en", 10 ** 18)], "lang string, n long")
    assert co.scored(phrases, sizes).first()["score"] == 1000 * 10 ** 33 // (3 * 10 ** 15 * (10 ** 15 + 7))
