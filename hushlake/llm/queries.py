"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, licences
from .common import table


def op9_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_best_fit(spark, sf_dir):
    from .packing import pack_documents, vocabulary

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op1_mix(spark, sf_dir):
    from .mixing import n_words, taken

    d = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return taken(d).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_language(spark, sf_dir):
    from .langid import language

    return language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_lines(spark, sf_dir):
    from .lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op3_tiles(spark, sf_dir):
    from .neardup_vec import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ann(spark, sf_dir):
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_rotation(spark, sf_dir):
    from .chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op6_licences(spark, sf_dir):
    from .licences import known, scan

    return scan(table(spark, sf_dir, "documents"), known(spark))


def op8_pages(spark, sf_dir):
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_language": op2_language,
    "op3_tiles": op3_tiles,
    "op4_rotation": op4_rotation,
    "op5_lines": op5_lines,
    "op6_licences": op6_licences,
    "op7_best_fit": op7_best_fit,
    "op8_pages": op8_pages,
    "op9_simhash": op9_simhash,
    "op10_ann": op10_ann,
}
ORACLES: dict[str, str] = {"op4_rotation": chat.SQL, "op6_licences": licences.sql()}
