"""Queries of this package, one for each numbered operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessella.llm import arrowfiles, chat, collocations, imatch, langid, merkle, mixing, packing, quality, secrets, simhash, toxicity, urlfilter


def queries():
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_chat_format": chat.op2_chat_format,
        "op3_imatch": imatch.op3_imatch,
        "op4_url_filter": urlfilter.op4_url_filter,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality": quality.op6_quality,
        "op7_mix": mixing.op7_mix,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_arrow_files": arrowfiles.op9_arrow_files,
        "op10_pack": packing.op10_pack,
        "op11_langid": langid.op11_langid,
        "op12_collocations": collocations.op12_collocations,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql():
    return {"op2_chat_format": chat.OP2_SQL, "op12_collocations": collocations.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
