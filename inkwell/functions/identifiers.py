"""Identifier checks as plain column arithmetic (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier layouts, PAN holder classes, the base-36 alphabet,
# and the base permutation of the Verhoeff scheme.
PAN_FORMAT = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
PAN_CLASSES = "PCHFATBLJG"
IFSC_FORMAT = r"^[A-Z]{4}0[A-Z0-9]{6}$"
GSTIN_FORMAT = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
CIN_FORMAT = r"^[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VERHOEFF_BASE = "1576283094"

_DIGITS = "0123456789"


def _dihedral(j: int, k: int) -> int:
    """Product in the dihedral group of the pentagon."""
    if j < 5:
        return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
    return 5 + (j - k) % 5 if k < 5 else (j - k) % 5


def _permutations() -> list[str]:
    rows = [_DIGITS]
    for _ in range(7):
        rows.append("".join(_VERHOEFF_BASE[int(c)] for c in rows[-1]))
    # row i maps digit d to base applied i times
    return rows


_PRODUCT = "".join(str(_dihedral(j, k)) for j in range(10) for k in range(10))
_PERMUTED = _permutations()


def _fold(digits: Column, length: int, offset: int) -> Column:
    """Check digit state after folding ``length`` digits from the right."""
    state: Column = F.lit(0)
    for i in range(length):
        digit = F.substring(digits, length - i, 1)
        step = F.translate(digit, _DIGITS, _PERMUTED[(i + offset) % 8]).cast("int")
        state = F.lit(_PRODUCT).substr(state * 10 + step + 1, F.lit(1)).cast("int")
    return state


def verhoeff_ok(col: Column) -> Column:
    """Twelve digits, not starting 0 or 1, with a zero Verhoeff state."""
    d = F.regexp_replace(col, r"\D", "")
    shape = d.rlike(r"^[2-9][0-9]{11}$")
    return F.when(shape, _fold(d, 12, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(col: Column) -> Column:
    """Check digit that completes an eleven-digit number."""
    inverse = "0432156789"
    return F.lit(inverse).substr(_fold(col, 11, 1) + 1, F.lit(1))


def _upper_no_space(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, r"\s+", ""))


def pan_reason(col: Column) -> Column:
    """NULL when the PAN is valid, else why not."""
    pan = F.upper(F.btrim(col, F.lit(" \t\n\r\x0b\x0c")))
    holder = F.substring(pan, 4, 1)
    return F.when(~pan.rlike(PAN_FORMAT), "invalid_pan_pattern").when(
        F.instr(F.lit(PAN_CLASSES), holder) == 0, F.concat(F.lit("invalid_pan_entity_type_"), holder)
    )


def ifsc_reason(col: Column, bank_known: Column) -> Column:
    """NULL when well formed and the bank prefix is registered."""
    return F.when(~_upper_no_space(col).rlike(IFSC_FORMAT), "invalid_ifsc_format").when(
        ~bank_known, "ifsc_needs_review"
    )


def ifsc_bank(col: Column) -> Column:
    return F.substring(_upper_no_space(col), 1, 4)


def gstin_digit(col: Column) -> Column:
    """Mod-36 check character of the first fourteen characters."""
    total: Column = F.lit(0)
    for i in range(14):
        value = F.instr(F.lit(BASE36), F.substring(col, i + 1, 1)) - 1
        if i % 2:
            # doubled value; carry into base 36 adds its digits
            total = total + value * 2 - F.when(value >= 18, 35).otherwise(0)
        else:
            total = total + value
    return F.lit(BASE36).substr(((F.lit(36) - total % 36) % 36) + 1, F.lit(1))


def gstin_reason(col: Column) -> Column:
    gstin = _upper_no_space(col)
    pan = pan_reason(F.substring(gstin, 3, 10))
    return (
        F.when(~gstin.rlike(GSTIN_FORMAT), "invalid_gstin_format")
        .when(pan.isNotNull(), F.concat(F.lit("gstin_"), pan))
        .when(F.substring(gstin, 15, 1) != gstin_digit(gstin), "invalid_gstin_checksum")
    )


def cin_reason(col: Column) -> Column:
    return F.when(~_upper_no_space(col).rlike(CIN_FORMAT), "invalid_cin_format")
