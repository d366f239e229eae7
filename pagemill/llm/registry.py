"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, name of its SQL there)
SQL = {
    "op1_ngram_join": ("ngram_join", "OP1_SQL"),
    "op3_mixing": ("mixing", "OP3_SQL"),
    "op4_chat": ("chat", "OP4_SQL"),
    "op6_repeats": ("repeats", "OP6_SQL"),
    "op8_warc": ("warc", "OP8_SQL"),
}
#: query -> module of this package that holds a function of that name
QUERIES = {
    "op1_ngram_join": "ngram_join",
    "op2_decontaminate": "decontaminate",
    "op3_mixing": "mixing",
    "op4_chat": "chat",
    "op5_token_counts": "token_counts",
    "op8_warc": "warc",
    "op6_repeats": "repeats",
    "op7_quality": "quality",
    "op9_pii": "pii",
    "op10_media": "media",
}


def _lazy(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _lazy(name, module) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in SQL.items()}
