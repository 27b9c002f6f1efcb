from pyspark.sql import functions as F

from lumengraph.llm import toxicity


def test_few_toxic_documents_still_rank(spark):
    """Ten toxic documents of a few words: no word reaches the usual significance."""
    insults = ["moron", "scumbag", "loser", "clown"]
    rows = []
    for i in range(160):
        text = " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(30))
        toxic = int(i % 14 == 0)
        rows.append((i, text + (f" {insults[i // 14 % 4]} {insults[(i // 14 + 1) % 4]}" if toxic else ""), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    scored = toxicity.score_documents(frame.select("doc_id", "text"), model).join(frame.select("doc_id", "toxic"), "doc_id")
    out = scored.where("held_out").groupBy("toxic").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    by = {r["toxic"]: r for r in out.collect()}
    assert by[1]["low"] > by[0]["high"]
