"""The pN_ queries of this subpackage's operators, by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from millrace.llm.bpe import p8_ids
from millrace.llm.canon import p2_found
from millrace.llm.leakage import p9_found, p9_removed
from millrace.llm.linkage import p4_found
from millrace.llm.markup import p6_found, p6_labels
from millrace.llm.mojibake import p10_found

QUERIES = {f.__name__: f for f in (p2_found, p4_found, p6_found, p6_labels, p8_ids, p9_found, p9_removed, p10_found)}
SQL: dict[str, str] = {}
