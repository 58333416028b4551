"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

import importlib

#: Query name -> (module of this subpackage, function of (spark, sf_dir)).
REGISTERED = {
    "op10_stupid_backoff": ("registered", "op10"),
    "op9_paragraph_minhash": ("registered", "op9"),
    "op8_suffix_radix": ("registered", "op8"),
    "op6_simhash_vptree": ("registered", "op6"),
    "op7_warc": ("registered", "op7"),
    "op2_mixing": ("registered", "op2"),
    "op3_sentencepiece": ("registered", "op3"),
    "op1_media_jpeg": ("registered", "op1"),
    "op4_language_id": ("registered", "op4"),
    "op5_multiset_fingerprint": ("registered", "op5"),
}


def _call(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {**{k: _call(*v) for k, v in REGISTERED.items()}, "pipeline": _pipeline}


def oracle_sql() -> dict:
    from . import mixing, ngrams, warc

    return {"op2_mixing": mixing.sql(), "op10_stupid_backoff": ngrams.sql(), "op7_warc": warc.sql()}
