"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from carrel.llm import chat, decontaminate, dedup, html, lm, merkle, mixing, quality, secrets, warc

QUERIES = {
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprints": merkle.op3_fingerprints,
    "op4_near_dedup": dedup.op4_near_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_html": html.op9_html,
    "op10_chat": chat.op10_chat,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op9_html": html.OP9_SQL, "op3_fingerprints": merkle.OP3_SQL, "op5_secrets": secrets.OP5_SQL, "op4_near_dedup": dedup.OP4_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op6_warc": warc.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op10_chat": chat.OP10_SQL}
