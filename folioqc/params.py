"""Thresholds of the comparison, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values of the comparison contract.
    paragraph_match: float = 0.72
    strong_match: float = 0.92
    line_break_match: float = 0.98
    min_alignment: float = 0.28
    min_ocr_confidence: float = 0.55
    drift_left: float = 0.026
    drift_top: float = 0.028
    drift_centre: float = 0.036
    drift_width: float = 0.05
    missing_overlap: float = 0.35
    region_overlap: float = 0.55
    dedup_rule: float = 0.72
    dedup_model: float = 0.82
    edge_band: float = 0.045
    colour_confidence: float = 0.9
    colour_iou: float = 0.08
    text_weight: float = 0.55
    position_weight: float = 0.45
    same_cell_bonus: float = 0.04
    position_scale: float = 1.2
    mismatch_text: float = 0.58
    mismatch_place: float = 0.82
    similar_text: float = 0.55
    similar_place: float = 0.78
    most_discrepancies: int = 12
    most_evidence: int = 8
    missing_text_confidence: float = 0.88
    line_break_base: float = 0.80
    line_break_step: float = 0.06
    line_break_most: float = 0.96
    drift_least: float = 0.82
    drift_most: float = 0.94
    sparse_text: int = 24
    ocr_confidence: float = 0.85
    line_overlap: float = 0.55
    listed_items: int = 36
    trimmed: int = 180
    content_threshold: int = 248
    colour_distance: float = 26.0
    rotations: tuple[int, ...] = (0, 90, 270)
    missing_gate: tuple[int, float] = (700, 0.00085)
    geometry_gate: tuple[int, float] = (650, 0.00075)
    colour_gate: tuple[int, float] = (500, 0.00055)
    similarity_size: tuple[int, int] = (720, 405)
    crop_padding: int = 8
    aspect_weight: float = 0.05


DEFAULT = Params()
