"""Small tables for the operators' tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents(spark, rows, folder):
    """Writes (doc_id, text[, lang]) rows as the table documents, and returns the folder."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), "x") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 3000), (6, "The cat’s «naïve» 12.5% ½ straße\x1c\x85 tab\there"), (7, "dup dup dup dup dup dup"), (8, "dup dup dup dup dup dup"), (9, "x" * 5000), (10, "日本語 テキスト 😀 é İ ﬁ")]
