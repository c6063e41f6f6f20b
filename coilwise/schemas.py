"""Declared schemas of the tables the engine reads and writes."""

FRAMES = (
    "frame_id bigint, coil_id bigint, seq int, camera string, domain string, split string, "
    "width int, height int, total_ms double"
)
GT_BOXES = "frame_id bigint, box_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double"
DETECTIONS = (
    "model string, frame_id bigint, det_id bigint, class_id int, "
    "x1 double, y1 double, x2 double, y2 double, conf double"
)
TILES = "tile_id bigint, source_id bigint, x0 int, y0 int, size int, label int, max_conf double"
MASK_RUNS = "frame_id bigint, class_id int, y int, x_start int, x_end int"
GREY_HIST = "frame_id bigint, level int, n bigint"
TIMINGS = "model string, device string, imgsz int, batch int, pass_id bigint, per_frame_ms double, ok boolean"
TRAIN_LOG = "run string, epoch int, time_s double, map50 double, map50_95 double"
CONTENT = "item_id bigint, split string, sequence_id string, content_sha256 string"
FRAME_EVENTS = "ts timestamp, line_id bigint, seq bigint, verdict string, total_ms double"
KNOTS = "x double, y double"
CALIBRATOR = "model string, method string, temperature double, slope double, intercept double, knots array<struct<x:double,y:double>>"
RULES = (
    "accept_max_defect_rate double, accept_max_p95 double, hold_min_defect_rate double, hold_min_p95 double, "
    "hold_min_critical_frames int, hold_class string, hold_class_frame_limit int"
)
