"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence make a row's posterior over the languages:

* its text: character trigrams under one model a language (naive Bayes, counted from a bounded
  sample of labelled documents), tempered to the weight of EFFECTIVE trigrams, as neighbouring
  trigrams are far from independent;
* the language that its markup declares and the suffix of its address: how often each value goes
  with each language, over all rows;
* its host: a prior that is smoothed hierarchically, the host's counts towards its domain's and
  these towards all rows'.

The counts are grouped aggregations of the text's own posteriors over all rows, and a row's own
share is taken out before it is judged. A row is rejected if its text has no letters, if its
posterior stays under LEAST, or if its text is so unlikely in its best language that it lies
DEVIATIONS standard deviations under the labelled rows.

Defined results: null and blank texts are rejected with no language; missing evidence (null or
empty) is left out; repeated rows count as rows; extra columns are ignored; an empty table gives
no rows; without labelled rows everything is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrilake.llm.common import Scratch, join_keyed, row_number

#: Labelled documents a language and languages of the text model, cells of its hashed table, and the text's weight.
SAMPLE, MOST_LANGUAGES, CELL_BITS, EFFECTIVE = 1500, 128, 16, 40
#: Pseudo-counts of hosts and domains, and of declared languages and suffixes.
HOST_WEIGHT, VALUE_WEIGHT = 10.0, 5.0
LEAST, DEVIATIONS = 0.5, 8.0


def trigrams(text: str) -> np.ndarray:
    """Cells of a text's letter trigrams; whatever is no letter separates words as one blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = LETTER[np.minimum(code, 0xFFFF).astype(np.int64)]
    code = np.where(letter, code, np.uint64(32))
    keep = letter | np.r_[True, letter[:-1]]
    code = np.r_[np.uint64(32), code[keep], np.uint64(32)]
    if len(code) < 3 or not letter.any():
        return np.empty(0, np.int64)
    key = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


LETTER = np.array([chr(i).isalpha() for i in range(0xFFFF)] + [True])


@dataclass
class TextModel:
    """Log-probability of each cell in each language, and what labelled rows' means look like."""

    languages: list[str]
    table: np.ndarray  # (cells, languages)
    usual: np.ndarray  # by language: mean of the rows' means, their deviation, deviation of one trigram

    def evidence(self, text: str) -> tuple[list[float], float, int]:
        """Tempered log-likelihoods, how many deviations the text lies under usual ones, its trigrams."""
        cells = trigrams(text)
        if not len(cells) or not self.languages:
            return [], 0.0, 0
        mean = np.zeros(len(self.languages))
        for k in range(0, len(cells), 1 << 16):
            mean += self.table[cells[k : k + (1 << 16)]].sum(0, dtype=np.float64)
        mean /= len(cells)
        centre, spread, single = self.usual[:, mean.argmax()]
        under = (centre - mean.max()) / np.sqrt(spread**2 + single**2 / len(cells))
        return (mean * min(len(cells), EFFECTIVE)).tolist(), float(under), len(cells)


def train(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Count trigrams in ``sample`` labelled documents (text, lang) of each language at most, taken by hash.

    Every label that documents carry is a language, the MOST_LANGUAGES most frequent ones if there
    are more; one with few documents has a flat model, which seldom wins.
    """
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''").select("doc_id", "lang", docs["text"].cast("string").alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return TextModel([], np.zeros((1 << CELL_BITS, 0)), np.zeros((3, 0)))
    rate = {r["lang"]: min(1.0, 1.2 * sample / r["n"]) for r in sizes}
    draw = F.xxhash64("doc_id", F.lit(3))
    share = F.pmod(draw, F.lit(1 << 20)) / float(1 << 20)
    taken = labelled.filter(share < F.try_element_at(F.create_map(*(F.lit(x) for pair in rate.items() for x in pair)), F.col("lang")))
    taken = taken.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))).filter(F.col("place") <= sample)

    def counted(batches):
        for batch in batches:
            of: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                of.setdefault(lang, []).append(trigrams(text))
            for lang, cells in of.items():
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(n)], ["lang", "cell", "n"])

    # a row a language and cell
    counts = taken.select("text", "lang").mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << CELL_BITS, len(languages)), 0.1)
    where = {lang: i for i, lang in enumerate(languages)}
    table[counts.column("cell").to_numpy(), [where[x] for x in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
    table = np.log(table / table.sum(0))
    # how usual texts lie: by language, from the trigram distribution itself and a spread of a tenth of it
    p = np.exp(table)
    centre = (p * table).sum(0)
    single = np.sqrt((p * (table - centre) ** 2).sum(0))
    return TextModel(languages, table.astype(np.float32), np.stack([centre, 0.1 * np.abs(centre), single]))


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` (row_id, id, text, declared, suffix, host, domain) with the text's evidence instead of it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = ["row_id", "id", "declared", "suffix", "host", "domain"]
    schema = "row_id long, id long, declared string, suffix string, host string, domain string, ll array<double>, under double, trigrams long"

    def judged(batches):
        m = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                found = [m.evidence(t or "") for t in batch.column("text").to_pylist()]
                new = [pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, [*others, "ll", "under", "trigrams"])

    return rows.select(*others, "text").mapInArrow(judged, schema)


def softmax(ll: str) -> Column:
    return F.expr(f"transform({ll}, x -> exp(x - array_max({ll})) / aggregate({ll}, 0D, (a, y) -> a + exp(y - array_max({ll}))))")


def tallied(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """For each value of ``key``: its rows, and the sums of their text posteriors by language."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{key}_n"), F.array(*(F.sum(F.col("p")[i]) for i in range(len(languages)))).alias(f"{key}_c"))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Judge ``rows`` (row_id, id, text, declared, suffix, host, domain).

    Gives row_id, id, language, confidence, accepted, text_language, trigrams.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "language")
    n = len(model.languages)
    names = F.array(*(F.lit(x) for x in model.languages)) if n else F.array().cast("array<string>")
    judged = scratch.keep(text_evidence(rows, model).withColumn("p", F.when(F.col("trigrams") > 0, softmax("ll"))), "text")
    told = judged.filter("trigrams > 0")
    total = told.agg(F.count("*"), *(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n))).first()
    size, share = total[0], list(total[1:])
    out = judged
    if n and size:
        every = f"array({', '.join(f'{x!r}D' for x in share)})"
        for key in ("host", "domain", "declared", "suffix"):
            tally = tallied(told, key, model.languages)
            out = join_keyed(out, tally, key, f"{key}_n", size, how="left")  # rows without a value meet nobody
        own = "coalesce(p[i], 0D)"
        over_all = f"(({every})[i] - {own} + 1D) / ({size - 1 + n}D)"
        domain = f"if(domain_c IS NULL, {over_all}, (domain_c[i] - {own} + {HOST_WEIGHT}D * {over_all}) / (domain_n - 1 + {HOST_WEIGHT}D))"
        host = f"if(host_c IS NULL, {domain}, (host_c[i] - {own} + {HOST_WEIGHT}D * {domain}) / (host_n - 1 + {HOST_WEIGHT}D))"
        terms = [f"ll[i] + ln(greatest({host}, 1e-9D))"]
        for key in ("declared", "suffix"):
            terms.append(f"if({key}_c IS NULL, 0D, ln(greatest({key}_c[i] - {own} + {VALUE_WEIGHT}D * {key}_n / {size}D, 1e-9D) / (({every})[i] - {own} + {VALUE_WEIGHT}D)))")
        score = f"transform(sequence(0, {n - 1}), i -> {' + '.join(terms)})"
        out = out.withColumn("score", F.when(F.col("trigrams") > 0, F.expr(score))).withColumn("posterior", softmax("score"))
    else:
        out = out.withColumn("posterior", F.lit(None).cast("array<double>"))
    best = F.array_max("posterior")
    pick = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    accepted = F.coalesce((best >= LEAST) & (F.col("under") <= DEVIATIONS), F.lit(False))
    return out.select("row_id", "id", pick(F.col("posterior")).alias("language"), best.alias("confidence"), accepted.alias("accepted"), pick(F.col("p")).alias("text_language"), "trigrams")


def as_rows(df: DataFrame, id: str, text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, domain: Column | None = None) -> DataFrame:
    """Columns that ``identify`` reads; empty evidence counts as none."""
    some = lambda c: F.nullif(F.lower(c), F.lit("")) if c is not None else F.lit(None).cast("string")
    return df.select(row_number(df).alias("row_id"), df[id].cast("long").alias("id"), text.cast("string").alias("text"), some(declared).alias("declared"), some(suffix).alias("suffix"), some(host).alias("host"), some(domain).alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages (page_id, url, html): visible text, declared language, host, domain, suffix."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z0-9#]+;", " ")
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return as_rows(pages, "page_id", text, declared, host, F.regexp_extract(host, r"([^.]+)\.?$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), model)
    return found.select(F.col("id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "accepted", "text_language", "trigrams")
