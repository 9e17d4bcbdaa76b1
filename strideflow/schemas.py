"""Table schemas and the fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, in stored order.
KEYPOINTS = (
    "nose", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow", "l_hip", "r_hip",
    "l_knee", "r_knee", "l_ankle", "r_ankle",
)
PHASES = ("approach", "hop_1", "hop_2", "hop_3", "hop_4", "final_jump", "landing")
HOPS = ("hop_1", "hop_2", "hop_3", "hop_4")
CONTACT_PHASES = (*HOPS, "landing")
ANGLES = ("FRONTAL", "SEMI_FRONT", "LATERAL", "SEMI_BACK", "UNKNOWN")
USABLE_ANGLES = ("LATERAL", "SEMI_BACK")
STATES = ("GROUND", "AIR", "OFF_TRACK_NEAR", "FINAL_FLIGHT", "LOST")
FEATURES = (
    "l_knee_angle", "r_knee_angle", "torso_lean", "ankle_sep_norm", "foot_asymmetry",
    "leg_extension_asym", "avg_foot_height", "arch_score", "hop_contact_score",
    "flight_score", "running_score", "landing_score", "feet_together_score",
    "body_extension",
)
MASK_MODES = ("color_masks", "cnn_masks", "keyframe_masks")

# Defaults for fields a document leaves out.
DEFAULT_FPS = 30.0
DEFAULT_WIDTH = 1280
DEFAULT_HEIGHT = 720
DEFAULT_CORRIDOR_M = 10.0

D, I, S, B, L = (T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.LongType())


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


POINT = _fields(x=D, y=D)
POLYGON = T.ArrayType(POINT)
KEYPOINT = _fields(name=S, x=D, y=D, conf=D)
AXIS = _fields(ox=D, oy=D, dx=D, dy=D)
SCALE = _fields(known_distance_m=D, ax=D, ay=D, bx=D, by=D)

#: One observation as stored inside an analysis document.
FRAME_DOC = _fields(
    frame_idx=I, timestamp_s=D, person_detected=B, person_bbox=T.ArrayType(D),
    keypoints=T.ArrayType(KEYPOINT), track_overlap=D, athlete_state=S, position_s=D,
    predicted_bbox=T.ArrayType(D), track_id=I, camera_angle=S, shoulder_ratio=D,
    angle_confidence=D, keypoints_valid=I, quality_score=D, usable_for_analysis=B,
    has_mask=B, mask_area_px=I, torso_height_px=D, shoulder_width_px=D, body_height_px=D,
    appearance_sim=D, tracking_source=S, manually_corrected=B, correction_source=S,
)
ANALYSIS_DOC = _fields(
    schema_version=I, analysis_version=I, derived_version=I,
    video_info=_fields(fps=D, duration_s=D, total_frames=I, width=I, height=I, codec=S),
    config=T.MapType(S, S), frames=T.ArrayType(FRAME_DOC),
)
FRAMES = T.StructType(
    [T.StructField("video_id", S), T.StructField("pass", S), *FRAME_DOC.fields]
)

# Raw calibration documents hold points as [x, y] lists; they are read as text
# arrays so that a malformed point becomes null instead of failing the file.
RAW_POLYGON = T.ArrayType(T.ArrayType(S))
_RAW_AXIS = _fields(origin=T.ArrayType(S), direction=T.ArrayType(S))
_RAW_SCALE = _fields(known_distance_m=S, point_a=T.ArrayType(S), point_b=T.ArrayType(S))
_RAW_KEYFRAME = _fields(
    frame_idx=I, track_polygon=RAW_POLYGON, corridor_polygon=RAW_POLYGON,
    landing_zone=RAW_POLYGON, axis=_RAW_AXIS, scale=_RAW_SCALE, source=S,
    venue_confidence=D,
)
_RAW_SEED = _fields(
    frame_idx=I, seed_points=RAW_POLYGON, labels=T.ArrayType(S),
    track_polygon=RAW_POLYGON, landing_zone=RAW_POLYGON,
)
_MASK_ENTRY = _fields(
    track=S, sand=S, source=S, confidence=D, track_area_norm=D, sand_area_norm=D,
)
CALIBRATION_DOC = _fields(
    schema_version=I, mode=S, keyframes=T.ArrayType(_RAW_KEYFRAME),
    seeds=T.ArrayType(_RAW_SEED), mask_frames=T.MapType(S, _MASK_ENTRY),
)
KEYFRAMES = _fields(
    video_id=S, frame_idx=I, track_polygon=POLYGON, corridor_polygon=POLYGON,
    landing_zone=POLYGON, axis=AXIS, scale=SCALE, source=S, venue_confidence=D,
)
CONTACT_DOC = _fields(
    index=I, frame_idx=I, timestamp_s=D, type=S, surface=S, phase=S, position_s=D,
    confidence=D, foot=S, source=S,
)
MARKER_DOC = _fields(
    frame_idx=I, phase=S, timestamp_s=D, pose_tag=S, source=S, confidence=D,
)
SECTIONS_DOC = _fields(
    schema_version=I, derived_version=I, athlete_id=S, confidence=D, notes=S,
    contacts=T.ArrayType(CONTACT_DOC), phase_markers=T.ArrayType(MARKER_DOC),
    phases=T.MapType(S, _fields(start_frame=I, end_frame=I)),
)
SESSION_DOC = _fields(
    schema_version=I, video_name=S, athlete_id=S, derived_version=I,
    timestamps_s=T.ArrayType(D), intervals_s=T.ArrayType(D), lengths_px=T.ArrayType(D),
    lengths_m=T.ArrayType(D), total_hops_px=D, total_hops_m=D,
    speeds_px_s=T.ArrayType(D), speeds_m_s=T.ArrayType(D),
    pose_vectors=T.ArrayType(T.ArrayType(D)), contact_phases=T.ArrayType(S),
    consistency_overall=D,
)
GT_SAMPLE = _fields(
    athlete_id=S, video_id=S, frame_idx=I, phase=S, pose_tag=S, surface=S,
    feature_vector=T.ArrayType(D), quality_score=D, camera_angle=S, source=S,
    analysis_dir=S,
)
GT_DOC = _fields(schema_version=I, samples=T.ArrayType(GT_SAMPLE))
_PROTOTYPE = _fields(centroid=T.ArrayType(D), weights=T.ArrayType(D), sample_count=I)
PROTOTYPES_DOC = _fields(
    schema_version=I, phases=T.MapType(S, _PROTOTYPE), pose_tags=T.MapType(S, _PROTOTYPE),
)
TEMPLATES_DOC = T.StructType(
    [*PROTOTYPES_DOC.fields, T.StructField("athlete_id", S)]
)
DETECTIONS = _fields(
    video_id=S, frame_idx=I, det_id=I, track_id=I, x1=D, y1=D, x2=D, y2=D, conf=D,
    mask_area_px=I, appearance_sim=D, track_ov=D, sand_ov=D,
)
META_DOC = _fields(athlete_id=S, note=S, date=S)
CORRECTIONS_LOG = _fields(
    video_id=S, frame_idx=I, correction_type=S, frames_updated=I, propagation_radius=I,
    sot_backend=S, logged_at=T.TimestampType(),
)
