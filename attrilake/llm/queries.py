"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from attrilake.llm import bpe, exact_dedup, html_extract, jpeg, language_id, minhash, packing, secret_scan, toxicity, unit_dedup
from attrilake.llm.common import ship

OPERATORS = {
    "op1_minhash_near_dedup": minhash.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_language_id": language_id.op5,
    "op6_jpeg_media": jpeg.op6,
    "op7_unit_dedup": unit_dedup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_html_extraction": html_extract.op9,
    "op10_lexical_packing": packing.op10,
}


def shipped(query):
    """The query, with this package sent to the executors before it runs."""

    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    found = {name: shipped(query) for name, query in OPERATORS.items()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op1_minhash_near_dedup": minhash.OP1_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op7_unit_dedup": unit_dedup.OP7_SQL}
