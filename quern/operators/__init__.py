from quern.operators.aggregate import count_rows, merge_partials, partial_sums, scalar_agg, scalar_aggs, sum_u32, sum_wrapping
from quern.operators.filter import filter_lt, filter_mask, mask_lt
from quern.operators.join import hash_build, hash_probe, hash_stats, inner_join, join_by_batches, noop_join, partition_wise_join, radix_join, require_matches
from quern.operators.partition import all_buckets, bucket, one_bucket, partition_by, partition_histogram, scatter_positions, shuffle_to_buckets
from quern.operators.setops import add_columns, concat_all, sort_by
from quern.operators.take import batch_positions, positions, take, take_batched

__all__ = [
    "add_columns", "all_buckets", "batch_positions", "bucket", "concat_all", "count_rows", "filter_lt", "filter_mask", "hash_build", "hash_probe", "hash_stats", "inner_join", "join_by_batches", "mask_lt",
    "merge_partials", "noop_join", "one_bucket", "partial_sums", "partition_by", "partition_histogram", "partition_wise_join", "positions", "radix_join", "require_matches", "scalar_agg", "scalar_aggs",
    "scatter_positions", "shuffle_to_buckets", "sort_by", "sum_u32", "sum_wrapping", "take", "take_batched",
]
