"""URL filter: host word segmentation by unigram Viterbi, then multinomial naive Bayes."""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bidframe.llm.common import cut, rows_of

#: (verdict, host, path prefix): a rule fits its host and all hosts below it.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Longest word a label is split into; buckets of the token counts; pseudo-count.
LONGEST, BUCKETS, ALPHA = 24, 1 << 15, 0.5

_LABEL = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[a-z]{1,%d}" % LONGEST)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one) and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(prefix)
        name = F.when(fits, F.lit(where + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def lexicon(texts: DataFrame) -> DataFrame:
    """(``word``, ``n``): how often the column ``text`` holds each lower-case word of its mark-up-free text."""
    plain = F.lower(F.regexp_replace("text", r"<[^>]*>", " "))
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"([a-z]+)"))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def segment(label: str, known: dict[str, float], total: float) -> list[str]:
    """Most likely words of a label (Viterbi over unigram log shares).

    An unknown word of length n has probability 10 / (total * 10^n), so that it is split
    only where its parts are known; digits stand alone.
    """
    best, last = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            p = known.get(word, math.log(10 / total) - len(word) * math.log(10))
            if best[start] + p > best[end]:
                best[end], last[end] = best[start] + p, start
    words, end = [], len(label)
    while end:
        words.append(label[last[end]:end])
        end = last[end]
    return words[::-1]


def _parts(batches):
    """Each run of letters of the hosts with all words it could hold."""
    for batch in batches:
        out = {"label": [], "word": []}
        for host in batch.column(0).to_pylist():
            for run in re.findall(r"[a-z]+", host):
                for start in range(len(run)):
                    for end in range(start + 1, min(len(run), start + LONGEST) + 1):
                        out["label"].append(run), out["word"].append(run[start:end])
            if len(out["word"]) > 50_000:
                yield rows_of({k: (pa.string(), v) for k, v in out.items()})
                out = {"label": [], "word": []}
        yield rows_of({k: (pa.string(), v) for k, v in out.items()})


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(``host``, ``words``): the distinct hosts split into words, in order.

    The words a host could hold meet the lexicon in a join, so the lexicon is never held
    whole; what comes back for one run of letters is bounded by its own length.
    """
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    runs = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("([a-z]+)"))).alias("host")).distinct()
    found = (runs.mapInArrow(_parts, "label string, word string").distinct().join(words, "word")
             .groupBy("label").agg(F.collect_list(F.struct("word", F.log(F.col("n") / total).alias("p"))).alias("known")))
    labels = runs.withColumnRenamed("host", "label").join(found, "label", "left")

    def split(batches):
        for batch in batches:
            result = [segment(x, {k["word"]: k["p"] for k in known or ()}, total)
                      for x, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield rows_of({"label": (pa.string(), batch.column(0)), "split": (pa.list_(pa.string()), result)})

    splits = labels.mapInArrow(split, "label string, split array<string>")
    places = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("([a-z]+|[0-9]+)"))).alias("at", "label"))
    whole = F.coalesce("split", F.array("label"))
    ordered = (places.join(splits, "label", "left").groupBy("host")
               .agg(F.sort_array(F.collect_list(F.struct("at", whole.alias("w")))).alias("all")))
    named = ordered.select("host", F.flatten(F.transform("all", lambda x: x["w"])).alias("words"))
    return hosts.join(named, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


@dataclass(frozen=True)
class Bayes:
    """Log odds of block to allow by token bucket, and of the classes."""

    odds: np.ndarray
    prior: float

    def score(self, tokens: list[str]) -> float:
        return self.prior + float(sum(self.odds[bucket(t)] for t in tokens))


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


def tokens(words: list[str] | None, path: str) -> list[str]:
    """Host words and path tokens; numbers of a path count by their length."""
    found = [f"h:{w}" for w in words or ()]
    for part in re.findall(r"[^\W_]+", path.lower()):
        found.append(f"p:{part}" if not part.isdigit() else f"p:#{len(part)}")
    return found


def train(judged: DataFrame) -> Bayes:
    """Multinomial naive Bayes from (``words``, ``path``, ``ruled``), ruled block or allow.

    Token counts of all ruled rows are summed into ``BUCKETS`` hash buckets, so the model
    has that size whatever the input. Rows that no rule judges are not used.
    """

    def count(batches):
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for words, path, ruled in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = sums[int(ruled == "block")]
                row[BUCKETS] += 1
                for t in tokens(words, path):
                    row[bucket(t)] += 1
        side, at = np.nonzero(sums)
        yield rows_of({"side": (pa.int32(), side.astype(np.int32)), "at": (pa.int32(), at.astype(np.int32)),
                       "n": (pa.int64(), sums[side, at])})

    rows = (judged.where("ruled is not null").select("words", "path", "ruled")
            .mapInArrow(count, "side int, at int, n bigint").groupBy("side", "at").agg(F.sum("n").alias("n")).collect())
    sums = np.zeros((2, BUCKETS + 1))
    for r in rows:
        sums[r.side, r.at] = r.n
    seen = sums[:, :BUCKETS] + ALPHA
    share = seen / seen.sum(1, keepdims=True)
    rows_by_side = sums[:, BUCKETS] + 1
    return Bayes(np.log(share[1] / share[0]), float(np.log(rows_by_side[1] / rows_by_side[0])))


def judge(pages: DataFrame, texts: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``, ``words``), a row for each page.

    A rule decides where one fits; naive Bayes over host words and path tokens, learnt from
    all pages that rules judge, decides the rest: block at log odds above 0. ``texts`` has a
    column ``text`` whose words make the lexicon. Null urls and those without ``://`` have
    empty host and path and are judged by the prior alone. Repeated rows stay.
    """
    host, path = host_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    split = cut(segmented(parsed.select("host").distinct(), lexicon(texts)))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    full = parsed.withColumn("rule", rule).withColumn("ruled", ruled).join(split, "host", "left")
    model = train(full)

    def run(batches):
        for batch in batches:
            ruled, scores = batch.column(4).to_pylist(), []
            for words, path in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist()):
                scores.append(model.score(tokens(words, path)))
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(ruled, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(verdict), pa.array(scores, pa.float64()), batch.column(5)],
                ["page_id", "host", "path", "rule", "verdict", "score", "words"])

    kind = pages.schema[id_col].dataType.simpleString()
    return full.select("page_id", "host", "path", "rule", "ruled", "words").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, score double, words array<string>")
