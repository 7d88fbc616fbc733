"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from inkwell.llm import bpe, decontaminate, jaccard, language, neighbours, pii, secrets, substrings, token_file, toxicity

MODULES = (decontaminate, neighbours, secrets, substrings, bpe, toxicity, jaccard, pii, language, token_file)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
