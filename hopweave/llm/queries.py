"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from hopweave.llm.band_join import OP13_SQL, op13_band_join
from hopweave.llm.bpe import op10_bpe
from hopweave.llm.embed_dedup import OP4_SQL, op4_embed_dedup
from hopweave.llm.html import op1_html
from hopweave.llm.langid import op7_language
from hopweave.llm.ngram_join import OP2_SQL, op2_ngram_join
from hopweave.llm.packing import op3_packing
from hopweave.llm.pii import op12_personal_data
from hopweave.llm.quality import op5_quality
from hopweave.llm.runs import op11_runs
from hopweave.llm.sharding import op8_sharding
from hopweave.llm.urlfilter import OP6_SQL, op6_url_filter
from hopweave.llm.vptree import op9_vptree

QUERIES = {
    f.__name__: f
    for f in (
        op1_html,
        op2_ngram_join,
        op3_packing,
        op4_embed_dedup,
        op5_quality,
        op6_url_filter,
        op7_language,
        op8_sharding,
        op9_vptree,
        op10_bpe,
        op11_runs,
        op12_personal_data,
        op13_band_join,
    )
}
ORACLES = {"op2_ngram_join": OP2_SQL, "op4_embed_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op13_band_join": OP13_SQL}
