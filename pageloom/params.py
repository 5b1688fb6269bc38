"""Operator parameters with the default values users of the tables expect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FontStyle:
    ref_range: tuple[float, float] = (0.85, 1.15)
    fallback: tuple[int, int] = (16, 32)
    relax_min: int = 12
    bias: float = 1.0
    line_spacing: float = 1.2
    compact_spacing: float | None = 1.1
    compact_threshold: float | None = 0.9


@dataclass(frozen=True)
class GroupRule:
    """Thresholds of the adjacent-region grouping."""

    y_gap_ratio: float = 0.55
    x_overlap_ratio: float = 0.9
    height_ratio: float | None = 0.6
    max_group_size: int | None = 4


@dataclass(frozen=True)
class ClusterRule:
    """Thresholds of the padded-box clustering."""

    pad_x_ratio: float = 0.15
    pad_y_ratio: float = 0.6
    pad_min: int = 4
    pad_max: int = 120
    max_dx_ratio: float = 2.2
    max_dy_ratio: float = 2.8
    min_x_overlap: float = 0.12


@dataclass(frozen=True)
class TileRule:
    tile_height: int = 1024
    overlap_ratio: float = 0.5
    min_tile_height: int = 256
    edge_padding: int = 64
    edge_band_ratio: float = 0.15
    edge_band_min_height: int = 128
