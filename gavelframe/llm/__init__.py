"""Operators for training-data corpora. `QUERIES` and `SQL` are what the driver's entry adds."""

from gavelframe.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from gavelframe.llm.decontam import op6_decontamination
from gavelframe.llm.html_text import op5_html_text
from gavelframe.llm.langid import op7_language_id
from gavelframe.llm.line_dedup import OP9_SQL, op9_line_dedup
from gavelframe.llm.mixing import OP2_SQL, op2_mixing
from gavelframe.llm.ngram_join import OP4_SQL, op4_ngram_join
from gavelframe.llm.periodic_runs import op13_periodic_runs
from gavelframe.llm.pii import op3_pii
from gavelframe.llm.quality import OP10_SQL, op10_quality
from gavelframe.llm.repeated_windows import OP11_SQL, op11_repeated_windows
from gavelframe.llm.sharding import OP1_SQL, op1_sharding
from gavelframe.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_repeated_windows": op11_repeated_windows,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {"op1_sharding": OP1_SQL, "op2_mixing": OP2_SQL, "op4_ngram_join": OP4_SQL, "op8_warc": OP8_SQL,
       "op9_line_dedup": OP9_SQL, "op10_quality": OP10_SQL, "op11_repeated_windows": OP11_SQL, "op12_conversation_repair": OP12_SQL}
