"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import personal, secrets, urls
from tidemark.llm.bpe import op2_bpe
from tidemark.llm.bytecnn import op1_quality
from tidemark.llm.contamination import op3_decontaminate
from tidemark.llm.langid import op4_langid
from tidemark.llm.pages import op7_pages
from tidemark.llm.personal import op13_personal
from tidemark.llm.repeats import op5_repeats
from tidemark.llm.rules import op10_rules
from tidemark.llm.runs import op11_runs
from tidemark.llm.secrets import op6_secrets
from tidemark.llm.simhash import op8_simhash
from tidemark.llm.spelling import op12_spelling
from tidemark.llm.urls import op9_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality, "op2_bpe": op2_bpe, "op3_decontaminate": op3_decontaminate, "op4_langid": op4_langid, "op5_repeats": op5_repeats, "op6_secrets": op6_secrets, "op7_pages": op7_pages, "op8_simhash": op8_simhash, "op9_urls": op9_urls, "op10_rules": op10_rules, "op11_runs": op11_runs, "op12_spelling": op12_spelling, "op13_personal": op13_personal}
SQL: dict[str, str] = {"op6_secrets": secrets.oracle(), "op9_urls": urls.oracle(), "op13_personal": personal.oracle()}
