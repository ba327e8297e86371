"""Thresholds of the operators: one frozen object, no literals in the operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    match_tol_frac: float = 0.01
    page_min_stable_s: float = 1.0
    max_samples: int = 31
    max_cells: int = 40
    grid_columns: int = 8
    template_min_ncc: float = 0.85
    template_min_margin: float = 0.05
    template_class_ncc: float = 0.8
    template_min_samples: int = 3
    stitch_min_ncc: float = 0.8
    stitch_min_margin: float = 0.05
    stitch_max_residual: float = 2.0
    stitch_exclude: int = 5
    stitch_min_overlap: float = 0.08
    light_min_level: float = 128.0
    line_y_match: float = 1.0
    max_fret: int = 24
    line_min_cover: float = 0.5
    line_spacing_tol: float = 0.15
    bar_min_cover: float = 0.9
    bar_merge: float = 0.5
    bar_edge_max_cover: float = 0.5
    extent_min_run: float = 1.0
    mark_min_h: float = 0.4
    mark_max_h: float = 1.2
    mark_max_dy: float = 0.4
    join_overlap: float = 0.7
    join_gap: float = 0.35
    report_pad: float = 2.0
    diff_level: int = 25
    still_frame: float = 0.02
    still_drift: float = 0.03
    sample_rate: int = 12
    page_trim_s: float = 0.25
    median_min_frames: int = 5
    page_merge_ncc: float = 0.98
    read_max_attempts: int = 2


DEFAULTS = Thresholds()

#: metric, kind of bound, bound (fixed values)
TARGETS = (
    ("recall", "min", 0.99),
    ("precision", "min", 0.995),
    ("fret_accuracy", "min", 0.99),
    ("unflagged_frac", "max", 0.002),
    ("x_error_median", "max", 0.0025),
    ("x_error_max", "max", 0.005),
    ("flag_rate", "max", 0.05),
)
