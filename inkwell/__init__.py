"""inkwell: corpus, tokenizer and paired-statistics operators on Spark DataFrames."""
