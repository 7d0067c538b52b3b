"""Settings of an analysis and predicates on voxel channels."""

from __future__ import annotations

from dataclasses import dataclass, field

CHANNELS = ("r", "g", "b", "gli", "density_norm", "ngrdi", "exr")  # by number in the enriched table


@dataclass(frozen=True)
class ChannelLimit:
    """A range for a channel; inclusive turns the range into one that is left out (see operators.enrich.limit_predicate)."""

    channel: int | str
    min: float | None = None
    max: float | None = None
    mask_na: bool = False
    inclusive: bool = False

    @property
    def name(self) -> str:
        return self.channel if isinstance(self.channel, str) else CHANNELS[self.channel]


@dataclass(frozen=True)
class AnalysisConfig:
    """Defaults of every setting of the analysis.  heading: antipodal (reproducible) or hashed."""

    voxel_sizes: tuple[float, ...] = (0.1,)
    vertical_axis: int = 2
    file_count: int = -1
    paths_to_skip: tuple[str, ...] = ()
    calculate_dbh: bool = True
    calculate_height: bool = True
    calculate_dimensions: bool = True
    calculate_live_canopy: bool = True
    calculate_transparency: bool = True
    mask_blue: bool = True
    rgb_outlier_filter: bool = True
    rgb_outlier_percentage: float = 5
    density_threshold: float = 0.0
    smoothing_window: int = 5
    ray_sample_count: int = 15_000
    heading: str = "antipodal"
    brightness_floor: float = 0.0
    filter_non_photosynthetic_voxels: bool = True
    limits: tuple[ChannelLimit, ...] = field(default=(ChannelLimit("ngrdi", min=0.005), ChannelLimit("gli", min=0.0)))
    required_hits: int = 2
    energy_threshold: float = 0.1
    ray_dissipation_factor: float = 0.5
    initial_energy: float = 1.0

    def __post_init__(self):
        if not self.voxel_sizes or min(self.voxel_sizes) <= 0:
            raise ValueError("voxel sizes must be positive")
        if not 0 <= self.rgb_outlier_percentage < 50:
            raise ValueError("the outlier percentage lies in 0..50")
        if self.heading not in ("antipodal", "hashed"):
            raise ValueError("heading is antipodal or hashed")
