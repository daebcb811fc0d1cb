"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from cellwright.llm import oracle
from cellwright.llm.decontaminate import op5_decontaminate
from cellwright.llm.htmltext import op2_html
from cellwright.llm.langid import op7_langid
from cellwright.llm.licences import op6_licences
from cellwright.llm.mixing import op8_mixing
from cellwright.llm.neardup import op3_neardup
from cellwright.llm.pii import op1_pii
from cellwright.llm.quality import op9_quality
from cellwright.llm.secrets import op10_secrets
from cellwright.llm.substrings import op4_substrings


def queries() -> dict:
    return {
        "op1_pii": op1_pii, "op2_html": op2_html, "op3_neardup": op3_neardup, "op4_substrings": op4_substrings, "op5_decontaminate": op5_decontaminate,
        "op6_licences": op6_licences, "op7_langid": op7_langid, "op8_mixing": op8_mixing, "op9_quality": op9_quality, "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_neardup": oracle.neardup(), "op4_substrings": oracle.substrings(), "op6_licences": oracle.licence_scan(), "op9_quality": oracle.quality_rules()}
