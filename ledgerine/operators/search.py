"""Prefix search over organisation names: a corpus, its postings, and ranking by BM25."""

from __future__ import annotations

import functools
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filings import first_by
from .store import LETTERS, Store, first_letters

K1, B = 1.2, 0.75


def organizations(tickers: DataFrame, nonprofits: DataFrame) -> DataFrame:
    """(title, path, source_type): tickers and, once per EIN, nonprofits."""
    sec = tickers.select(F.col("title"), F.concat(F.lit("/ticker/"), "ticker").alias("path"), F.lit("SEC").alias("source_type"))
    first = first_by(nonprofits, ["EIN"], F.col("row_ord"))
    return sec.unionByName(first.select(F.col("TAXPAYER_NAME").alias("title"), F.concat(F.lit("/ein/"), "EIN").alias("path"), F.lit("IRS").alias("source_type")))


@functools.cache
def marked_letters() -> tuple[str, str]:
    """Lower-case letters that stand for a letter with marks, and the letters without them, below U+2000 (Hangul and ideographs have none)."""
    found = [(c, d[0]) for c in map(chr, range(0x80, 0x2000)) if c.islower() and len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def folded(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or follow it."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *marked_letters()), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """The same as ``tokens``, for the words of one query."""
    bare = unicodedata.normalize("NFC", query).lower().translate(str.maketrans(*marked_letters()))
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare if unicodedata.category(c) != "Mn")
    return kept.split()


def postings(corpus: DataFrame) -> DataFrame:
    """(term, path, title, source_type, f, length): all three columns are indexed."""
    words = F.concat(tokens(F.col("title")), tokens(F.col("path")), tokens(F.col("source_type")))
    rows = corpus.select("title", "path", "source_type", words.alias("w")).withColumn("length", F.size("w"))
    return rows.withColumn("term", F.explode("w")).groupBy("term", "title", "path", "source_type", "length").agg(F.count("*").alias("f"))


def limit_of(value: str | int | None) -> int:
    """Ten, unless a number from 1 to 50 is given."""
    try:
        n = int(str(value))
    except ValueError:
        return 10
    return n if 1 <= n <= 50 else 10


def search(index: DataFrame, corpus_size: DataFrame, query: str, limit: str | int | None = None) -> DataFrame:
    """(title, path, score): all words must occur, the last one as a prefix; best first, ties by path.

    ``corpus_size``: one row (n, mean_length). A blank query finds nothing.
    """
    spark = index.sparkSession
    words = query_words(query)
    empty = spark.createDataFrame([], "title string, path string, score double")
    if not words:
        return empty
    parts = [(i, w, i == len(words) - 1) for i, w in enumerate(words)]
    hit = [F.startswith(F.col("term"), F.lit(w)) if prefix else F.col("term") == w for _, w, prefix in parts]
    found = index.where(reduce(lambda a, b: a | b, hit))
    which = F.array_compact(F.array(*[F.when(h, F.lit(i)) for (i, _, _), h in zip(parts, hit, strict=True)]))
    per = found.withColumn("i", F.explode(which)).groupBy("i", "title", "path", "source_type", "length").agg(F.sum("f").alias("f"))
    n = per.groupBy("i").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    term = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = per.join(F.broadcast(n), "i").crossJoin(F.broadcast(corpus_size)).withColumn("s", term)  # as many rows as the query has words, and one row
    best = scored.groupBy("title", "path", "source_type").agg(F.sum("s").alias("score"), F.countDistinct("i").alias("hits")).where(F.col("hits") == len(words))
    return best.select("title", "path", "score").orderBy(F.desc("score"), "path").limit(limit_of(limit))


def size_of(corpus: DataFrame) -> DataFrame:
    words = F.size(tokens(F.col("title"))) + F.size(tokens(F.col("path"))) + F.size(tokens(F.col("source_type")))
    return corpus.agg(F.count("*").alias("n"), F.avg(words).alias("mean_length"))


class Index:
    """Postings kept in files by the first two characters of their term, in tables of a store that grow by appends.

    A query reads the files of its words alone, those of a prefix of one character all that begin with it. Frequencies are those of the
    whole corpus, as all postings of a term stand in its files; so the ranking is that of an index made in one go.
    """

    def __init__(self, store: Store):
        self.store = store

    def add(self, corpus: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds organisations that are not there yet; a numbered batch that comes again adds nothing."""
        self.store.append("postings", postings(corpus), batch)
        size = F.size(tokens(F.col("title"))) + F.size(tokens(F.col("path"))) + F.size(tokens(F.col("source_type")))
        self.store.append("corpus_size", corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("words")), batch)

    def clear(self) -> None:
        self.store.clear("postings")
        self.store.clear("corpus_size")

    def postings_of(self, words: list[str]) -> DataFrame | None:
        """Rows of the files in which the postings of the words stand, the last one as a prefix."""
        heads = [first_letters(w) for w in words[:-1]]
        last = first_letters(words[-1])
        wide = len(words[-1]) < LETTERS
        return self.store.rows_where("postings", lambda cell: cell in heads or (cell.startswith(last) if wide else cell == last))

    def search(self, query: str, limit: str | int | None = None) -> DataFrame:
        """As ``search``: (title, path, score)."""
        words = query_words(query)
        found, sizes = self.postings_of(words) if words else None, self.store.read("corpus_size")
        if found is None or sizes is None:
            return self.store.spark.createDataFrame([], "title string, path string, score double")
        size = sizes.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("mean_length"))
        return search(found, size, query, limit)
