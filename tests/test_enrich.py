import pandas as pd
from pyspark.sql import functions as F

from voxlake.operators import enrich


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, source_id long, title string, body string, rating long")


def sources(spark):
    return spark.createDataFrame([(1, "reddit"), (2, "google_play")], "id long, platform string")


def prepared(spark, rows, **options):
    done = spark.createDataFrame([], "document_id long")
    return enrich.prepare(enrich.candidates(documents(spark, rows), done, sources(spark), None), **options)


def test_candidates_oldest_first(spark):
    docs = documents(spark, [(i, 1, "t", "b", None) for i in (5, 3, 9, 1)])
    done = spark.createDataFrame([(3,)], "document_id long")
    assert [r.id for r in enrich.candidates(docs, done, sources(spark), 2).collect()] == [1, 5]
    assert sorted(r.id for r in enrich.candidates(docs, done, sources(spark), None).collect()) == [1, 5, 9]


def test_short_texts_get_rules(spark):
    rows = [(1, 2, None, "ok", 1), (2, 2, None, "nice", None), (3, 1, None, "a long enough text", None), (4, 1, None, None, None)]
    ready = prepared(spark, rows)
    assert {r.document_id for r in ready.where("is_short").collect()} == {1, 2, 4}
    ruled = {r.document_id: r for r in enrich.rule_enrichment(ready.where("is_short")).collect()}
    assert [ruled[i].sentiment_label for i in (1, 2, 4)] == ["negative", "positive", "neutral"]
    assert ruled[1].model_name == "fallback_rules" and ruled[1].competitor_mentions == [] and ruled[4].summary == ""


def test_long_texts_are_cut_for_the_scorer(spark):
    ready = prepared(spark, [(1, 1, None, "x" * 50, None)], max_chars=20).first()
    assert len(ready.text) == 20 and not ready.is_short


def test_scorer_replies(spark):
    seen_ratings = spark.createDataFrame([(i, "google_play" if i % 2 else "reddit", 5, f"text {i}") for i in range(1, 8)],
                                         "document_id long, platform string, rating long, text string").coalesce(1)

    def scorer(batch):
        ids = list(batch["document_id"])
        if 4 in ids:
            raise RuntimeError("remote failure")
        rows = [{"document_id": i, "sentiment_label": "neutral", "summary_snippet": "first"} for i in ids if i != 2]
        rows += [{"document_id": ids[0], "sentiment_label": "negative", "summary_snippet": str(batch["rating"].iloc[0]),
                  "competitor_mentions": ["A", "a"], "feature_request_flag": True}]
        return pd.DataFrame(rows + [{"document_id": 999}])

    got = {r.document_id: r for r in enrich.score(seen_ratings, scorer, batch_size=3).collect()}
    assert {i: r.status for i, r in got.items()} == {
        1: "enriched", 2: "no_reply", 3: "enriched", 4: "failed", 5: "failed", 6: "failed", 7: "enriched"}
    assert sum(r.failed_batch for r in got.values()) == 1
    # The last reply wins; only app reviews hand their rating over.
    assert got[1].sentiment_label == "negative" and float(got[1].summary_snippet) == 5.0 and got[1].feature_request_flag
    stats = enrich.statistics(enrich.score(seen_ratings, scorer, batch_size=3)).first()
    assert (stats.candidates, stats.enriched, stats.skipped_short, stats.failed_batches) == (7, 3, 0, 1)


def test_rule_scorer_agrees_with_the_rule_columns(spark):
    from voxlake.functions.labels import rule_sentiment

    rows = [(i, t, r) for i, (t, r) in enumerate([("BAD", None), ("so good", 3), ("x", 1), ("crash", 4), ("y", None)])]
    pdf = pd.DataFrame(rows, columns=["document_id", "text", "rating"])
    native = spark.createDataFrame(rows, "document_id long, text string, rating long").select(
        rule_sentiment(F.col("text"), F.col("rating")).alias("v")).collect()
    assert list(enrich.rule_scorer(pdf)["sentiment_label"]) == [r.v for r in native]


def test_reply_parsing(spark):
    replies = spark.createDataFrame(
        [(1, '{"documents":[{"document_id":7,"sentiment_label":"Mixed","feature_request_flag":true,"competitor_mentions":[" A ","a",""]},'
             '{"document_id":"x"},{"sentiment_label":"neutral"},{"document_id":7,"primary_issue_category":"BUG"}]}'),
         (2, "no json"), (3, '{"documents":{"document_id":1}}'), (4, "[]"), (5, '{"documents":[{"document_id":8}]}')],
        "batch_id long, reply string")
    parsed = enrich.parse_replies(replies)
    assert sorted((r.document_id, r.position) for r in parsed.collect()) == [(7, 0), (7, 3), (8, 0)]
    last = {r.document_id: r for r in enrich.last_reply(parsed, "batch_id", "position").select("document_id", *enrich.clean_reply("m")).collect()}
    assert last[7].primary_issue_category == "bug" and last[7].sentiment_label == "neutral" and last[8].summary == ""


def test_promotion(spark):
    rows = spark.createDataFrame(
        [(1, '{"sentiment":{"label":"mixed"},"feature_request_flag":1,"rating":4.9}'), (2, '{"sentiment_label":"neutral","feature_request_flag":true,"competitor_mentions":["a"]}'), (3, "bad"), (4, None)],
        "document_id long, metadata_json string")
    got = {r.document_id: r for r in enrich.promote(rows).collect()}
    assert (got[1].sentiment_label, got[1].feature_request_flag, got[1].rating) == ("mixed", True, 4)
    assert got[2].competitor_mentions == ["a"] and got[2].feature_request_flag
    assert got[3].sentiment_label is None and got[4].feature_request_flag is False
