"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import importance, url_filter
from stockroom.llm.ann import op7_ann_search
from stockroom.llm.bpe import op8_bpe_codec
from stockroom.llm.importance import op11_importance_resampling
from stockroom.llm.langid import op1_language_id
from stockroom.llm.packing import op6_best_fit_packing
from stockroom.llm.periodic import op13_periodic_runs
from stockroom.llm.pseudo_lm import op5_lm_scoring
from stockroom.llm.quality import op9_quality_rules
from stockroom.llm.secret_scan import op4_secret_scan
from stockroom.llm.simhash import op2_simhash_dedup
from stockroom.llm.suffix_dedup import op3_suffix_dedup
from stockroom.llm.topk import op10_exact_top_k
from stockroom.llm.url_filter import op12_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ann_search": op7_ann_search,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op10_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op11_importance_resampling": importance.SQL,
    "op12_url_filter": url_filter.SQL,
}
