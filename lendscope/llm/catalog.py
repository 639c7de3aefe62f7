"""The queries of the subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lendscope.llm.chat_format import OP12_SQL, op12_chat_format
from lendscope.llm.decontamination import op6_decontamination
from lendscope.llm.jaccard_join import OP4_LINKS_SQL, OP4_SQL, op4_jaccard_join, op4_jaccard_links
from lendscope.llm.lexical_search import OP11_SQL, op11_lexical_search
from lendscope.llm.packing import op9_packing
from lendscope.llm.periodic_runs import op13_periodic_runs
from lendscope.llm.quality_rules import OP8_SQL, op8_quality_rules
from lendscope.llm.secret_scan import OP7_SQL, op7_secret_scan
from lendscope.llm.sharding import op5_sharding
from lendscope.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from lendscope.llm.toxicity import op3_toxicity
from lendscope.llm.url_filter import OP2_SQL, op2_url_filter
from lendscope.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op4_jaccard_links": op4_jaccard_links,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_chat_format": op12_chat_format,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op4_jaccard_links": OP4_LINKS_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_chat_format": OP12_SQL,
}
