"""Secret scans by patterns and by character Markov models, in DataFrame operations alone.

Three fixed kinds of spans come from patterns (assign, access, hex). The method adds a fourth:
tokens under which a first-order Markov model of random strings is likelier than one of ordinary
identifiers, by MIN_RATIO nats a character on average and MIN_TOTAL nats in all, so that a short
token needs more a character. Tokens are runs of TOKEN's characters: of 16 or more, or of 8
or more if letters and digits both occur. The labelled samples are counted over all documents: the
values that the patterns find (of an assignment the value alone, without its keyword) are the random
strings, tokens that no span covers the ordinary identifiers. A token that stands n times weighs
1 + log2(n), so copies count little, and its whole weight leaves the ordinary counts before it is
judged, so no token vouches for itself however often it stands. Tokens that look random leave the
ordinary sample, and all are judged once more without them. Ordinary pairs back off to the single
characters' frequencies; the random model is mixed half and half with a uniform one, so alphabets
that no pattern caught still count as random.

Offsets are code points, ends exclusive. Defined results: null text counts as empty and has no
spans; repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.llm.common import Scratch, join_keyed, row_number, sha256_hex

#: The patterns of the kinds, in their order, and what a match needs to stay.
KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Candidate tokens of the models: long ones, and shorter ones that mix letters and digits.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}|(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{8,15})"
ALPHABET = 65
#: Log-likelihood ratio from which a token is a secret: nats a character on average, and nats in all.
MIN_RATIO, MIN_TOTAL = 1.0, 14.0
#: Weight, in counts, of the single characters' frequencies in a pair's.
BACK_OFF = 500
#: Lengths that one sum covers when offsets are added up.
RUN = 256

SPAN = "struct<start:bigint,end:bigint,value:string>"


def with_spans(rows: DataFrame, name: str, pattern: str, value_group: int = 0) -> DataFrame:
    """Add ``name``: an array of SPAN, every match of ``pattern`` in ``text`` with group ``value_group``.

    What lies between the matches, and they themselves, add up to the offsets: sums over runs of
    RUN lengths first, so that a text with a million matches stays cheap.
    """
    found = F.col("text").rlike(pattern)
    rx = F.lit(pattern)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_m", F.when(found, F.regexp_extract_all("text", rx, F.lit(0))).otherwise(none))
    some = F.size("_m") > 0
    rows = rows.withColumn("_v", F.when(some, F.regexp_extract_all("text", rx, F.lit(value_group))).otherwise(none) if value_group else F.col("_m"))
    rows = rows.withColumn("_p", F.when(some, F.transform(F.split("text", pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_l", F.expr("zip_with(_p, _m, (a, b) -> cast(a + coalesce(char_length(b), 0) as bigint))"))
    rows = rows.withColumn("_s", F.expr(f"if(size(_m) > 0, transform(sequence(0, (size(_l) - 1) div {RUN}), b -> aggregate(slice(_l, cast(b * {RUN} + 1 as int), {RUN}), 0L, (a, x) -> a + x)), array())"))
    rows = rows.withColumn("_b", F.expr("if(size(_m) > 0, transform(sequence(0, size(_s) - 1), b -> aggregate(slice(_s, 1, b), 0L, (a, x) -> a + x)), array())"))
    before = f"_b[cast(i div {RUN} as int)] + aggregate(slice(_l, cast((i div {RUN}) * {RUN} + 1 as int), i % {RUN}), 0L, (a, x) -> a + x) + _p[i]"
    rows = rows.withColumn("_at", F.expr(f"if(size(_m) > 0, transform(sequence(0, size(_m) - 1), i -> {before}), array())"))
    spans = f"if(size(_m) > 0, transform(sequence(0, size(_m) - 1), i -> named_struct('start', _at[i], 'end', _at[i] + char_length(_m[i]), 'value', _v[i])), cast(array() as array<{SPAN}>))"
    return rows.withColumn(name, F.expr(spans)).drop("_m", "_v", "_p", "_l", "_s", "_b", "_at")


def found_spans(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, row_id and the spans of each kind and of the candidate tokens; ``carry`` adds the row as ``doc``."""
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("doc")] if carry else []
    rows = docs.select(row_number(docs).alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *row)
    rows = with_spans(rows, "assign", KINDS["assign"], 2)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.char_length(s["value"]) >= LEAST_VALUE))
    rows = with_spans(rows, "access", KINDS["access"])
    rows = rows.withColumn("access", F.filter("access", lambda s: F.char_length(s["value"]) >= LEAST_ACCESS))
    rows = with_spans(rows, "hex", KINDS["hex"])
    return with_spans(rows, "tokens", TOKEN).drop("text")


def covered(token: str = "t") -> str:
    """Whether a base span overlaps the token."""
    return "(" + " OR ".join(f"exists({k}, s -> s.start < {token}.end AND {token}.start < s.end)" for k in KINDS) + ")"


#: Places of a token's pairs of characters in the 128 x 128 table.
PAIRS = "transform(sequence(1, size(c) - 2), i -> c[i - 1] * 128 + c[i])"


def distinct_tokens(labelled: DataFrame) -> DataFrame:
    """A row a token and label: times, weight, sorted pairs, and how often each character is before and after another."""
    found = labelled.groupBy("token", "random").agg(F.count("*").alias("times"))
    found = found.withColumn("weight", 1 + F.log2("times")).withColumn("c", F.expr("transform(split(token, '', -1), x -> ascii(x))"))
    of = "transform(sequence(0, 127), x -> size(filter(slice(c, {}, size(c) - 2), y -> y = x)))"
    return found.withColumns({"pairs": F.expr(f"array_sort({PAIRS})"), "before": F.expr(of.format(1)), "after": F.expr(of.format(2))}).drop("c")


def train_markov(tokens: DataFrame) -> dict[str, list[float]]:
    """Logarithms of the random model's table of 128 x 128 pairs, and the ordinary tokens' weights of pairs and characters.

    They cover all ``tokens``; the table that comes to the driver has 2 * ALPHABET ** 2 rows at most.
    """
    counts = tokens.select("random", "weight", F.explode("pairs").alias("pair")).groupBy("random", "pair").agg(F.sum("weight").alias("weight")).collect()
    table = {True: {}, False: {}}
    for r in counts:
        table[r["random"]][r["pair"]] = r["weight"]
    before = {k: [0.0] * 128 for k in table}
    after = [0.0] * 128
    for k, pairs in table.items():
        for pair, n in pairs.items():
            before[k][pair >> 7] += n
            after[pair & 127] += 0 if k else n
    uniform = 1 / ALPHABET
    trained = ((table[True].get(p, 0) + BACK_OFF * uniform) / (before[True][p >> 7] + BACK_OFF) for p in range(128 * 128))
    return {"random": [math.log((t + uniform) / 2) for t in trained], "pair": [table[False].get(p, 0.0) for p in range(128 * 128)], "first": before[False], "second": after, "total": [sum(after) + ALPHABET / 2]}


def scan(docs: DataFrame, least: float = MIN_RATIO, carry: bool = False) -> DataFrame:
    """row_id, doc_id, base and spans: arrays of (start, no, kind, end) in order; a row a document."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(found_spans(docs, carry), "spans")
    values = rows.select(F.explode(F.concat(*KINDS)).alias("t")).select(F.col("t.value").alias("token"), F.lit(True).alias("random"))
    others = rows.select(F.explode("tokens").alias("t"), *KINDS).filter(~F.expr(covered())).select(F.col("t.value").alias("token"), F.lit(False).alias("random"))
    tokens = scratch.keep(distinct_tokens(values.unionByName(others)), "tokens")
    secret = (F.col("ratio") >= least) & (F.col("ratio") * F.size("pairs") >= MIN_TOTAL)
    # suspects leave the ordinary sample, and all are judged anew by what remains
    judged = tokens.withColumn("ratio", F.when(~F.col("random"), _ratio(train_markov(tokens)))).withColumn("suspect", F.coalesce(secret, F.lit(False)))
    judged = scratch.keep(judged.drop("ratio"), "judged")
    scratch.drop("tokens")
    others = judged.filter("NOT random").withColumn("weight", F.when(F.col("suspect"), 0.0).otherwise(F.col("weight")))
    secrets = others.withColumn("ratio", _ratio(train_markov(judged.filter("NOT suspect")))).filter(secret)
    secrets = scratch.keep(secrets.select(F.md5("token").alias("key"), "times"), "found")
    rows = rows.withColumn("tokens", F.expr(f"filter(tokens, t -> NOT {covered()})"))
    # only rows with candidates are dealt out
    each = rows.select("row_id", F.explode("tokens").alias("t")).withColumn("key", F.md5("t.value"))
    each = join_keyed(each, secrets, "key", "times", each.count()).groupBy("row_id").agg(F.collect_list("t").alias("_secret"))
    some = rows.filter(F.size("tokens") > 0).join(each, "row_id", "left").withColumn("tokens", F.coalesce("_secret", F.filter("tokens", lambda t: F.lit(False)))).drop("_secret")
    scored = rows.filter(F.size("tokens") == 0).unionByName(some)
    order = "named_struct('start', s.start, 'no', {}, 'kind', '{}', 'end', s.end)"
    base = "concat(" + ", ".join(f"transform({k}, s -> {order.format(i, k)})" for i, k in enumerate(KINDS)) + ")"
    scored = scored.withColumn("base", F.array_sort(F.expr(base)))
    added = f"transform(tokens, s -> {order.format(len(KINDS), 'random')})"
    return scored.withColumn("spans", F.array_sort(F.expr(f"concat(base, {added})")))


def _ratio(model: dict[str, list[float]]) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters under the model without the token itself."""
    of = {k: f"cast(split('{','.join(f'{x:.9g}' for x in v)}', ',') as array<double>)" for k, v in model.items()}
    single = f"(get({of['second']}, z.p & 127) - weight * get(after, z.p & 127) + 0.5) / ({model['total'][0]!r}D - weight * size(pairs))"
    ordinary = f"(get({of['pair']}, z.p) - weight * z.n + {BACK_OFF} * {single}) / (get({of['first']}, shiftright(z.p, 7)) - weight * get(before, shiftright(z.p, 7)) + {BACK_OFF})"
    return F.expr(f"""aggregate(concat(pairs, array(-1)), named_struct('p', -1, 'n', 0, 's', 0D),
        (z, p) -> if(p = z.p, named_struct('p', p, 'n', z.n + 1, 's', z.s),
            named_struct('p', p, 'n', 1, 's', z.s + if(z.n = 0, 0D, z.n * (get({of['random']}, z.p) - ln({ordinary}))))),
        z -> z.s / size(pairs))""")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", least: float = MIN_RATIO) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one; n_chars counts anew."""
    rows = scan(docs, least, carry=True)
    # between spans: from the furthest end so far to the next start
    pieces = F.expr("""aggregate(spans, named_struct('to', 0L, 'out', cast(array() as array<string>)),
        (z, s) -> if(s.start >= z.to,
            named_struct('to', s.end, 'out', concat(z.out, array(substring(text, cast(z.to as int) + 1, cast(s.start - z.to as int))))),
            named_struct('to', greatest(z.to, s.end), 'out', z.out)),
        z -> concat(z.out, array(substring(text, cast(z.to as int) + 1))))""")
    rows = rows.select("doc", "spans", F.col("doc.text").alias("text"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, mark))
    out = rows.select("doc", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, sha256_hex(joined("base")).alias("base_sha256"), joined("spans").alias("spans"))
