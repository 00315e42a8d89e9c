"""Imports every operator, so that the registry is complete."""

from . import op1_rules, op10_mtree, op11_variants, op12_merkle, op13_curve, op2_substring, op3_mixing, op4_mincut, op5_suffix, op6_lines, op7_language, op8_order_minhash, op9_packing  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
