from quern.sources.generate import dense_index, fk_batch_local, join_sides, literal, random_relation, random_u32, take_indices
from quern.sources.results import benchmark_rows, read_benchmark_json, run_line, write_csv
from quern.sources.tables import table

__all__ = ["benchmark_rows", "dense_index", "fk_batch_local", "join_sides", "literal", "random_relation", "random_u32", "read_benchmark_json", "run_line", "table", "take_indices", "write_csv"]
