"""Flag categories of a sample, one bit each (fixed values)."""

FLAG_BITS = {"PRIOR": 0, "MISSING": 1, "INVALID": 2, "ILLCOND": 3, "DIVERGE": 4, "NOSOL": 5, "GOOB": 6, "BOOM": 7, "GNULL": 8, "LOWSNR": 9, "GVAR": 10, "INVMODEL": 11, "INVWGHT": 12, "NULLWGHT": 13, "MAD": 14, "SKIPSOL": 15}
FL = {name: 1 << bit for name, bit in FLAG_BITS.items()}
