"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, html, langid, minhash, mixing, packing, quality, secrets, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_packing": packing.op3_packing,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_language": langid.op5_language,
    "op6_repeats": suffix.op6_repeats,
    "op7_audio": audio.op7_audio,
    "op8_quality": quality.op8_quality,
    "op9_html": html.op9_html,
    "op10_secrets": secrets.op10_secrets,
    # Of operators that SQL can say in part, that part.
    "chat_digests": chat.chat_digests,
    "media_payloads": audio.media_payloads,
    "quality_counts": quality.quality_counts,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op4_near_duplicates": minhash.ORACLE,
    "op6_repeats": suffix.ORACLE,
    "op10_secrets": secrets.ORACLE,
    "chat_digests": chat.DIGESTS_SQL,
    "media_payloads": audio.PAYLOADS_SQL,
    "quality_counts": quality.COUNTS_SQL,
}
