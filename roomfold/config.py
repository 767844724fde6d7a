"""Thresholds of every stage. Results depend on these exact defaults."""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA_VERSION = "1.0.0"


@dataclass(frozen=True)
class FrameConfig:
    """RGB-D keyframes, fusion and registration."""

    frame_stride: int = 1
    max_frames: int = 80
    min_translation: float = 0.08
    min_rotation: float = 8.0
    depth_min: float = 0.15
    depth_max: float = 8.0
    min_valid_depth_pixels: int = 100
    min_keyframes: int = 2
    min_frame_points: int = 20
    frame_voxel: float = 0.05
    fusion_voxel: float = 0.03
    max_points_per_frame: int = 20_000
    max_fused_points: int = 500_000
    normal_radius: float = 0.2
    normal_max_nn: int = 30
    icp_coarse: float = 0.25
    icp_fine: float = 0.08
    icp_iterations: int = 40
    neighbor_min_fitness: float = 0.25
    neighbor_max_rmse: float = 0.06
    loop_min_separation: int = 8
    loop_radius: float = 0.8
    loop_max_rotation: float = 35.0
    max_loops_per_frame: int = 2
    loop_min_fitness: float = 0.5
    loop_min_overlap: float = 0.5
    loop_max_rmse: float = 0.05
    max_translation_change: float = 0.5
    max_rotation_change: float = 15.0
    edge_prune: float = 0.25
    weak_prior_information: float = 0.01


@dataclass(frozen=True)
class VideoConfig:
    extraction_fps: float = 3.0
    max_keyframes: int = 60
    min_keyframes: int = 6
    blur: float = 30.0
    dark: float = 12.0
    duplicate: float = 2.0
    min_gap: float = 0.25
    depth_frame_stride: int = 1
    pixel_stride: int = 3
    up_coherence: float = 0.7
    min_registered: int = 3


@dataclass(frozen=True)
class PhotoConfig:
    min_images: int = 2
    max_images: int = 8
    min_dimension: int = 64
    blur: float = 20.0
    brightness_min: float = 8.0
    brightness_max: float = 247.0
    contrast_min: float = 5.0
    duplicate: float = 2.0
    min_registered: int = 2
    up_coherence: float = 0.6


@dataclass(frozen=True)
class ScaleConfig:
    """Video defaults; photo rooms use 50 correspondences and two frames."""

    min_correspondences: int = 100
    min_frame_correspondences: int = 15
    min_frames: int = 3
    outlier: float = 3.5
    relative_floor: float = 0.05
    consistency: float = 0.3
    max_relative_mad: float = 0.25
    max_reprojection: float = 2.0
    border: int = 5
    depth_min: float = 0.2
    depth_max: float = 15.0
    min_room_quality: float = 0.4
    max_room_relative_mad: float = 0.25


@dataclass(frozen=True)
class GeometryConfig:
    voxel: float = 0.03
    outlier_neighbors: int = 20
    outlier_ratio: float = 2.5
    normal_radius: float = 0.15
    normal_max_nn: int = 30
    min_points: int = 200
    max_points: int = 300_000
    ransac_distance: float = 0.025
    ransac_iterations: int = 1000
    seed: int = 7
    max_planes: int = 24
    horizontal_degrees: float = 12.0
    vertical_degrees: float = 12.0
    ceiling_parallel_degrees: float = 5.0
    min_plane_inliers: int = 100
    min_horizontal_area: float = 1.0
    min_floor_coverage: float = 0.2
    min_ceiling_coverage: float = 0.4
    floor_tolerance: float = 0.65
    ceiling_top_tolerance: float = 0.3
    min_ceiling_height: float = 2.0
    max_ceiling_height: float = 5.0
    min_wall_length: float = 0.7
    min_wall_height: float = 1.2
    wall_base_tolerance: float = 0.35
    merge_degrees: float = 5.0
    merge_distance: float = 0.06
    merge_gap: float = 0.08
    corner_merge: float = 0.04
    extension: float = 0.3
    min_intersection_degrees: float = 15.0
    min_polygon_area: float = 1.0
    quantile: float = 0.005


@dataclass(frozen=True)
class OpeningConfig:
    min_score: float = 0.55
    min_pixel_area: int = 150
    morphology: int = 3
    sample_stride: int = 4
    depth_min: float = 0.15
    depth_max: float = 15.0
    wall_distance: float = 0.18
    endpoint_tolerance: float = 0.12
    low: float = 0.02
    high: float = 0.98
    min_points: int = 25
    merge_distance: float = 0.25
    min_views: int = 2
    single_view_quality: float = 0.82
    door_min_width: float = 0.45
    door_max_width: float = 2.5
    window_min_width: float = 0.3
    window_max_width: float = 5.0
    min_height: float = 0.4
    max_dispersion: float = 0.25
    floor_contact: float = 0.22
    boundary_tolerance: float = 0.2
    cell: float = 0.04
    min_cell_points: int = 1
    min_boundary_support: float = 0.45
    min_wall_points: int = 100
    default_ceiling: float = 3.0
    passage_height: float = 1.6


@dataclass(frozen=True)
class DamageConfig:
    min_score: float = 0.35
    min_pixel_area: int = 80
    sample_stride: int = 4
    min_points: int = 20
    depth_min: float = 0.15
    depth_max: float = 15.0
    surface_distance: float = 0.18
    low: float = 0.02
    high: float = 0.98
    merge_distance: float = 0.3
    min_views: int = 2


@dataclass(frozen=True)
class StitchConfig:
    min_matches: int = 30
    min_inliers: int = 12
    min_inlier_ratio: float = 0.25
    ratio_test: float = 0.75
    ransac_distance: float = 0.18
    ransac_iterations: int = 400
    registration_distance: float = 0.15
    registration_min_fitness: float = 0.25
    registration_max_rmse: float = 0.12
    registration_voxel: float = 0.08
    acceptance: float = 0.35
    max_iterations: int = 300
    max_overlap_area: float = 0.08
    max_overlap_ratio: float = 0.02
    boundary_distance: float = 0.35
    cycle_error: float = 0.35
    max_pairs: int | None = None  # accepted edges of a property; none: all


@dataclass(frozen=True)
class ConfidenceConfig:
    level: float = 0.95
    allow_tier_prior: bool = False
    photo_error: float = 0.10
    video_error: float = 0.08
    lidar_error: float = 0.04


@dataclass(frozen=True)
class PlanConfig:
    tolerance: float = 0.02
    precision: int = 2
    show_confidence: bool = True
