"""Every registered query runs on the smallest tables; the pipeline against a brute-force version of its filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, language_id, quality
from quern.llm.queries import QUERIES
from quern.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": "page_id host path rule verdict",
    "op2_decontamination": "doc_id item_id shared containment",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_token_output": "doc_id start n_tokens ids_crc32",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op13_importance_resampling": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert [c for c in out.columns if c in wanted] == wanted
    rows = out.count()
    table, key = ("pages", "page_id") if wanted[0] == "page_id" else ("documents", "doc_id")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows >= n if name == "op9_best_fit_packing" else rows > 0 if name == "op2_decontamination" else rows == n
    assert name == "op2_decontamination" or out.select(key).distinct().count() == n


def test_pipeline_equals_its_filters(spark, tmp_path):
    """Each stage's rows by a second way: language and quality row by row, near-copies by all pairs, passages by all items, packing by its bound."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(160)
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        seen[name] = kept
        assert name == "best-fit packing" or kept.columns == docs.columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    language, good, single, clean = (texts(seen[name]) for name, _ in corpus_pipeline.STAGES[:4])
    scorer = language_id.Scorer(language_id.learned(docs))
    predicted = {i: scorer.predict(t) for i, t in texts(docs).items()}
    assert set(language) == {i for i, (lang, score) in predicted.items() if lang != "und" and score >= 0.5}
    judged = quality.judged(spark.createDataFrame(docs.where(F.col("doc_id").isin(list(language))).collect(), docs.schema))
    assert set(good) == {r["doc_id"] for r in judged.collect() if r["kept"]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in good.items())}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert set(single) == set(root.values())
    items = decontaminate.Items([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()], 0.8)
    parts = {}
    for k, s in enumerate(items.shingles):
        parts.setdefault(len(next(iter(s))), []).append(s)
    def held(text):
        words = decontaminate.words_of(text)
        own = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in parts}
        return any(len(s & own[n]) >= 0.8 * len(s) - 1e-9 for n, some in parts.items() for s in some)
    assert set(clean) == {i for i, t in single.items() if not held(t)}
    by = encoder(tokenizer_path())
    total = {i: len(by.library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    packed = seen["best-fit packing"].collect()
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in clean} == total
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= np.ceil(1.1 * sum(total.values()) / 2048) + 1


def test_pipeline_of_no_documents(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        assert kept.count() == 0
