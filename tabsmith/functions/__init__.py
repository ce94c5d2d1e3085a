from tabsmith.functions.expr import (hash_hex, hash_unit, nan_to_null, r6,
                                     row_hash, safe_div)

__all__ = ["hash_hex", "hash_unit", "nan_to_null", "r6", "row_hash", "safe_div"]
