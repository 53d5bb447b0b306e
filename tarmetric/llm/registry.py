"""The registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmetric.llm import chat, codes, decontaminate, licenses, neighbours, packing, quality, repair, secrets, sharding, simhash, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_licenses": licenses.op2_licenses,
        "op3_urls": urls.op3_urls,
        "op4_packing": packing.op4_packing,
        "op5_chat": chat.op5_chat,
        "op6_sharding": sharding.op6_sharding,
        "op7_simhash": simhash.op7_simhash,
        "op8_secrets": secrets.op8_secrets,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_repair": repair.op11_repair,
        "op12_warc": warc.op12_warc,
        "op13_codes": codes.op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.ORACLE, "op3_urls": urls.ORACLE, "op5_chat": chat.ORACLE, "op11_repair": repair.ORACLE, "op12_warc": warc.ORACLE, "op13_codes": codes.ORACLE}
