"""The queries of this subpackage and the SQL of those that SQL can express."""

from lodestone.llm import op1_packing, op2_language, op3_simhash, op4_decontaminate, op5_lines, op6_pii, op7_warc, op8_toxicity, op9_quality, op10_licenses, op11_collocations, op12_chat, op13_negatives

MODULES = (op1_packing, op2_language, op3_simhash, op4_decontaminate, op5_lines, op6_pii, op7_warc, op8_toxicity, op9_quality, op10_licenses, op11_collocations, op12_chat, op13_negatives)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
