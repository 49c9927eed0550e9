"""Texts of a language or script that the model has not learned."""

from cupola.llm import langid

FOREIGN = {
    900001: "Привет мир, это обычный текст на русском языке, которого никто здесь не знает.",
    900002: "これは日本語の文章です。誰も知らない言語で書かれています。",
    900003: "Tämä on suomenkielinen teksti, jota kukaan täällä ei tunne eikä ymmärrä lainkaan.",
    900004: "%% q ## $$ x @@ ! z ~~ j ^^ w ** k",
    900005: "Αυτό είναι ένα κείμενο στα ελληνικά.",
}


def test_unclaimed_texts_go_and_learned_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet".replace("sf0.001", "sf0.01"))
    base = docs.limit(1)
    from pyspark.sql import functions as F

    planted = spark.createDataFrame(list(FOREIGN.items()), "id long, t string").crossJoin(base).withColumns({"doc_id": F.col("id"), "text": F.col("t"), "lang": F.lit(None).cast("string")}).select(*docs.columns)
    kept = {r.doc_id for r in langid.stage(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert not kept & set(FOREIGN)
    assert len(want - kept) <= 0.002 * len(want)
