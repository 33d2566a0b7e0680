"""The pipeline's stages against brute force."""

import re
import time
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_llm_operators import ODD, DOCS, base_spans, brute_components, check_pieces
from tokenizers import Tokenizer

from attrilake.llm import common, secret_scan
from attrilake.sources.shared import shared_dir


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the smallest tables hold no secret: one more document, of another's words the other way round
    one = max((r for r in docs.collect() if r.lang == "en"), key=lambda r: len(r.text))
    text = f"{' '.join(reversed(one.text.split()))} password = 'Zx81kQ9w' and {'0a' * 16}"
    docs = docs.unionByName(spark.createDataFrame([one.asDict() | {"doc_id": 10**6, "text": text, "n_chars": len(text)}], docs.schema))
    before, columns = rows_of(docs), docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    language, exact, near, secrets, packed = kept
    assert all(k.columns == columns for k in kept[:-1])
    # language: clean documents stay, as they are but for the language
    assert {i: r.text for i, r in rows_of(language).items()} == {i: r.text for i, r in before.items()}
    assert np.mean([r.lang == before[i].lang for i, r in rows_of(language).items()]) > 0.97
    # exact copies: the longest, then the smallest id
    groups = defaultdict(list)
    for i, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), i))
    assert set(rows_of(exact)) == {min(g)[1] for g in groups.values()}
    # near copies: the first of each component
    components = brute_components({i: before[i].text for i in rows_of(exact)}, 80)
    assert set(rows_of(near)) == {c for _, c in components.values()}
    # secrets: every document stays, with a mark for each run of overlapping base spans and of what the models add
    found = {r.doc_id: r for r in secret_scan.scan(near).collect()}
    assert set(rows_of(secrets)) == set(rows_of(near)) == set(found)
    assert [s.kind for s in found[10**6].base] == ["assign", "hex"]
    for d, r in rows_of(secrets).items():
        assert [(s.start, s.no, s.kind, s.end) for s in found[d].base] == base_spans(before[d].text)
        text, at = "", 0
        for s in sorted(found[d].spans, key=lambda s: (s.start, s.no)):
            if s.start >= at:
                text += before[d].text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.text == text + before[d].text[at:] and r.n_chars == len(r.text)
    slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*slow.encode(r.text, add_special_tokens=False).ids, 2] for i, r in rows_of(secrets).items()}
    check_pieces(packed.collect(), want)


def test_run_gives_the_last_stages_rows(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert set(got.columns) >= {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None
    before = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pieces, docs = got.collect(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_pieces(pieces, {r.doc_id: [*slow.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()})
    assert len({p.doc_id for p in pieces}) < len(before)


def test_no_stage_shuffles_the_texts_it_keeps(spark, sf_dir, tmp_path):
    """Whatever size a table may have to be broadcast, kept rows are found by their numbers; only renamed languages are joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id % 50 == 7}
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 7, F.lit(None).cast("string")).otherwise(F.col("lang")))
    docs.unionByName(docs.limit(30)).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = sorted((r.doc_id, r.text) for r in docs.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, docs, sf_dir)
            plan = out._jdf.queryExecution().executedPlan().toString()
            plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
            got = sorted((r.doc_id, r.text) for r in out.collect())
            if name == "language_id":
                assert got == before and all(r.lang for r in out.collect() if r.doc_id in wrong)
                same, _, renamed = plan.partition("SortMergeJoin")
                assert renamed and "BroadcastHashJoin" in same
            else:
                assert 0 < len(got) < len(before) and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_chosen_rows_by_marks_and_by_join(spark):
    ids = [0, 7, 8, 32767, 32768, 100_000, (5 << 33) + 3, (5 << 33) + 70_000]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], f"{common.ROW} long, text string").repartition(3)
    for some in ([], ids[::2], ids[1::2], ids):
        found = spark.createDataFrame([(i,) for i in some], f"{common.ROW} long")
        for most in (common.MARK_BYTES, 0):
            got = common.chosen(rows, found, most)
            assert got.columns == rows.columns and sorted(r.text for r in got.collect()) == sorted(map(str, some))


def test_small_batches_for_python(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def most(rows):
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        with common.small_batches(spark, rows):
            return max(r.n for r in sizes.collect())

    assert most(1000) <= 1000 and most(100) <= 100 and spark.conf.get(key) == before


def test_a_lazy_result_outlives_later_stages_of_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.without_copies(spark, docs, sf_dir)
    other = corpus_pipeline.without_copies(spark, docs.limit(20), sf_dir)
    later = corpus_pipeline.without_near_copies(spark, other, sf_dir)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert first.count() > later.count() > 0 and other.count() <= 20


def test_odd_rows_reach_every_stage(spark, tmp_path):
    docs = spark.createDataFrame(ODD, DOCS).repartition(3)
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(p.length for p in out.collect()) == sum(len(slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
        else:
            got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
            assert out.columns == docs.columns and len(got) <= len(ODD)
            if name == "secret_scan":
                assert len(got) == len(ODD)
            else:
                assert all(g in texts for g in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "12345", "en", "s", 5), (4, None, None, None, None)]
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_a_stages_tables_go_once_nothing_can_read_them(spark, sf_dir, tmp_path):
    """Stages that are called one by one, each result written, leave the tables of the last one."""
    top = Path(shared_dir(spark).removeprefix("file://")) / "attrilake"
    folders = lambda: {f.name for f in top.iterdir()}

    def left(others, most):
        for _ in range(50):  # what Spark's listeners still hold goes a little later
            common.reclaim(spark)
            if len(folders() - others) <= most:
                return True
            time.sleep(0.2)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.without_copies(spark, docs, sf_dir)
    held = out.filter("doc_id % 2 = 0")
    want = {r.doc_id for r in out.collect() if r.doc_id % 2 == 0}
    del out
    others = folders()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert left(others, 1), name
    # what a DataFrame made from a result reads stays as long as that is there
    assert {r.doc_id for r in held.collect()} == want
    del held, out
    assert left(others - {f for f in others if f.startswith("stage-exact")}, 0)
