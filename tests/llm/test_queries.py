"""The registered queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from clientela.llm import language_id, mixing
from clientela.llm.folds import held_out
from clientela.llm.oracles import ORACLES
from clientela.llm.queries import QUERIES, WEIGHTS, domain_labels

from .test_near_dedup import literal as near_literal
from .test_packing import encoded
from .test_private import literal_spans
from .test_quality import literal_statistics

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_source_mixing": "doc_id bigint, tokens bigint, p_good double, p_poor double, p_toxic double, rate double, copies int",
    "op4_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int, passages bigint",
    "op5_pii_sanitisation": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_revealing int",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint",
    "op7_secret_scan": "doc_id bigint, start bigint, end bigint, held_out boolean, score double, is_secret boolean",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, languages string, accepted boolean",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_columns_and_rows(spark, documents, name):
    result = QUERIES[name](spark, SF).cache()
    found = ", ".join(f"{c} {t}" for c, t in result.dtypes)
    assert found.startswith(COLUMNS[name])
    if name not in ("op7_secret_scan", "op10_best_fit_packing"):
        assert result.count() == documents.count()
        assert result.select("doc_id").exceptAll(documents.select("doc_id")).count() == 0
    if "held_out" in result.columns:
        for r in result.select("doc_id", "held_out").collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    result = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in result.dtypes) == COLUMNS[name]
    assert sorted(map(tuple, result.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_personal_data_and_statistics_of_whole_texts(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in QUERIES["op5_pii_sanitisation"](spark, SF).collect():
        kinds = Counter(kind for kind, _, _ in literal_spans(texts[r["doc_id"]]))
        assert tuple(r)[1:5] == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
    for r in QUERIES["op6_quality_rules"](spark, SF).collect():
        assert tuple(r)[1:6] == literal_statistics(texts[r["doc_id"]])


def test_pipeline_by_stages(spark, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = {name: None for name in names}
    now = documents
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        docs[name] = now
        if name != "packing":
            assert now.dtypes == documents.dtypes
    rows = {name: sorted(map(tuple, frame.collect()), key=str) for name, frame in docs.items()}

    model = language_id.fit_languages(documents.where(~held_out()))
    accepted = {r["doc_id"] for r in language_id.identify_languages(documents, model).where("accepted").collect()}
    source = sorted(map(tuple, documents.collect()))
    first = [r for r in source if r[0] in accepted]
    assert rows["language_id"] == sorted(first, key=str)

    seen, second = set(), []
    for r in first:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if text not in seen:
            seen.add(text)
            second.append(r)
    assert rows["exact_dedup"] == sorted(second, key=str) and len(second) < len(first)

    kept = {i for i, _, component, _ in near_literal([r[:2] for r in second]) if i == component}
    third = [r for r in second if r[0] in kept]
    assert rows["near_dedup"] == sorted(third, key=str) and len(third) < len(second)

    labels = domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_domains(docs["near_dedup"], labels, WEIGHTS).collect()}
    fourth = [r for r in third for _ in range(copies[r[0]])]
    assert rows["mixing"] == sorted(fourth, key=str) and len(fourth) < len(third)

    want = Counter()
    for r in fourth:
        ids = encoded(r[1])
        want.update((r[0], n, len(ids[s : s + 2048])) for n, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r[0], r[1], r[3]) for r in rows["packing"]) == want


def test_run_writes_each_stage_and_reads_it_again(spark, documents, monkeypatch):
    seen = []

    def small(spark, docs, sf_dir):
        seen.append((docs.inputFiles()[0], sf_dir))
        return docs.where("doc_id < 50")

    def ids(spark, docs, sf_dir):
        seen.append((docs.inputFiles()[0], docs.count()))
        return docs.select("doc_id")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("small", small), ("ids", ids)])
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id"] and result.count() == 50
    assert seen[0][0].endswith(f"{SF}/documents.parquet") and seen[0][1] == SF and seen[1][1] == 50
    assert "documents.parquet" not in seen[1][0]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_documents_without_letters_are_rejected_and_clean_ones_stay(spark, documents, make):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    odd = make([(10**6, "12 34 #"), (10**6 + 1, None), (10**6 + 2, "qzx wvk " * 30)], lang=None)
    kept = {r["doc_id"] for r in stage(spark, documents.unionByName(odd), SF).collect()}
    assert not kept & {10**6, 10**6 + 1, 10**6 + 2}
    assert kept == {r["doc_id"] for r in documents.collect()}
