from quern.functions.bits import minimum, round_up_multiple, round_up_pow2
from quern.functions.hashing import key64_hash, radix_bucket, wang32, with_wang32

__all__ = ["key64_hash", "minimum", "radix_bucket", "round_up_multiple", "round_up_pow2", "wang32", "with_wang32"]
