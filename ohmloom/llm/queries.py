"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import compact_windows, decontamination, line_dedup, mixing, near_dedup, quality, suffix_dedup, token_counts, token_planes, topk

_MODULES = {
    "op1_decontamination": decontamination,
    "op2_suffix_dedup": suffix_dedup,
    "op3_near_dedup": near_dedup,
    "op4_line_dedup": line_dedup,
    "op5_quality": quality,
    "op6_token_planes": token_planes,
    "op7_mixing": mixing,
    "op8_token_counts": token_counts,
    "op9_topk": topk,
    "op10_compact_windows": compact_windows,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
