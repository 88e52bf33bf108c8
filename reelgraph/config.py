"""Default thresholds and vocabularies.

Every operator takes these as parameters; the defaults below are fixed values
that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QualityLimits:
    min_blur: float = 25.0
    max_dark_ratio: float = 0.9
    max_bright_ratio: float = 0.9
    min_brightness: float = 8.0
    max_brightness: float = 248.0


@dataclass(frozen=True)
class DedupLimits:
    window_ms: int = 10_000
    min_correlation: float = 0.92
    max_hamming: int = 6


QUALITY = QualityLimits()
DEDUP = DedupLimits()

# --- fixed values -----------------------------------------------------------

SECTION_PADDING_MS = 2_000
SAMPLE_INTERVAL_SECONDS = 2.0
MIN_SAMPLE_STEP_MS = 500
MIN_SPACING_MS = 500
SCENE_THRESHOLD = 0.25
MAX_UPLOAD_BYTES = 2 * 1024 * 1024 * 1024
MAX_STRUCTURE_ATTEMPTS = 2
MAX_RELATIONS_PER_FRAME = 20
DISPLAY_LIMIT = 5
RECENT_LIMIT = 30

RAW_TRANSCRIPT_KIND = "transcript_raw"
RAW_TRANSCRIPT_VERSION = "1"
STRUCTURED_TRANSCRIPT_KIND = "transcript_tree"
STRUCTURED_TRANSCRIPT_VERSION = "8"
TREE_VERSION = "2.2"
REPORT_VERSION = "1.1"
BUSINESS_FRAME_MODE = "section_polished_text_business_frame_text_and_query_graph_v1"

FRAME_TYPE_KEYWORDS = {
    "wiring_frame": ("接线", "正极", "负极", "信号", "线"),
    "operation_frame": ("安装", "拧", "固定", "插", "按压", "工具", "螺丝"),
    "completion_frame": ("完成", "结束", "结果", "测试", "确认", "检查"),
    "alignment_frame": ("对齐", "孔位", "位置", "连接", "卡住", "预留"),
    "overview_frame": ("介绍", "展示", "组件", "零件", "工具", "材料"),
}

LABEL_SYNONYMS = {
    "手部": "hand",
    "手": "hand",
    "工具": "tool",
    "tool": "tool",
    "螺丝刀": "screwdriver",
    "十字螺丝刀": "screwdriver",
    "六角螺丝刀": "screwdriver",
    "screwdriver": "screwdriver",
    "舵机": "servo",
    "servo": "servo",
    "底座": "robot_arm_base",
    "基座": "robot_arm_base",
    "底盘": "robot_arm_base",
    "机械臂底座": "robot_arm_base",
    "base": "robot_arm_base",
    "robot arm base": "robot_arm_base",
    "robot_arm_base": "robot_arm_base",
    "大臂": "upper_arm_link",
    "上臂": "upper_arm_link",
    "upper arm link": "upper_arm_link",
    "upper_arm_link": "upper_arm_link",
    "小臂": "lower_arm_link",
    "前臂": "lower_arm_link",
    "lower arm link": "lower_arm_link",
    "lower_arm_link": "lower_arm_link",
    "机械臂": "arm",
    "arm": "arm",
    "线": "wire",
    "电线": "wire",
    "wire": "wire",
    "控制板": "control board",
    "屏幕": "screen",
    "孔位": "screw hole",
    "螺丝孔": "screw hole",
    "螺丝": "screw",
    "screw": "screw",
    "抓手": "gripper_assembly",
    "夹手": "gripper_assembly",
    "gripper": "gripper_assembly",
    "gripper assembly": "gripper_assembly",
    "gripper_assembly": "gripper_assembly",
    "手腕": "wrist_joint",
    "腕关节": "wrist_joint",
    "wrist joint": "wrist_joint",
    "wrist_joint": "wrist_joint",
    "夹爪": "gripper_assembly",
    "正极": "positive terminal",
    "负极": "negative terminal",
    "+": "positive terminal",
    "-": "negative terminal",
    "信号": "signal",
    "s": "signal",
}

NEGATIVE_LABELS = ("blur", "occluded")

# Signals a section expects to see, by frame type; any other type is an overview.
EXPECTED_SIGNALS = {
    "alignment_frame": ("clear_key_region", "close_up"),
    "operation_frame": ("clear_key_region", "detail_rich"),
    "wiring_frame": ("clear_key_region", "detail_rich"),
    "completion_frame": ("clear_key_region", "sharp"),
    "overview_frame": ("close_up", "detail_rich"),
}

IDEAL_AREA = {
    "alignment_frame": 0.05,
    "operation_frame": 0.08,
    "wiring_frame": 0.08,
    "completion_frame": 0.10,
    "overview_frame": 0.04,
}
IDEAL_AREA_DEFAULT = 0.06

# Relations that score by geometry when the scene graph does not state them.
GEOMETRIC_RELATIONS = (
    "near",
    "overlaps",
    "occludes",
    "fixed_to",
    "attached_to",
    "connected_to",
    "mounted_to",
    "inserted_into",
    "has_part",
    "part_of",
)

VIDEO_MEDIA_TYPES = {
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".webm": "video/webm",
    ".mkv": "video/x-matroska",
}
IMAGE_MEDIA_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
}
DOCUMENT_MEDIA_TYPES = {
    ".svg": "image/svg+xml",
    ".md": "text/markdown; charset=utf-8",
    ".pdf": "application/pdf",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

DELETABLE_STATUSES = ("uploaded", "completed", "completed_with_warnings", "failed", "deleting")
UNPARSEABLE_STATUSES = ("deleting", "queued", "processing")
TERMINAL_STATUSES = ("completed", "completed_with_warnings", "failed")
INTERRUPTED_MESSAGE = "Background job was interrupted by service restart."
FAILED_PUBLIC_MESSAGE = "视频解析失败"

FEATURE_TRANSCRIPT = "转写文本"
FEATURE_KEYFRAMES = "筛选业务帧"
FEATURE_MARKDOWN = "生成 Markdown"
TRANSCRIPT_MODEL_CALLS = ("local_asr.audio_transcriptions", "qwen.chat.completions.transcript_tree")
PARSE_ENDPOINT = "video_parse_job"
ASR_MODEL_LABEL = "Qwen/Qwen3-ASR-1.7B"
STRUCTURE_MODEL = "qwen3.7-plus"
KEYFRAME_MODEL_LABEL = "本地 yolov8s-world + sam2.1_b.pt"
MARKDOWN_MODEL_LABEL = "本地 Markdown 生成"
LOCAL_MODEL_LABEL = "本地流程"
USAGE_STATUS_LABELS = {"processing": "进行中", "failed": "失败"}
USAGE_STATUS_DEFAULT = "已完成"

SAFE_VIDEO_ID = "^[A-Za-z0-9_-]{1,64}$"
CLIP_MARKER = "\n\n[内容过长，已截断。]"
UNKNOWN_DURATION = "未知"
UNKNOWN_TEXT = "未识别。"
DEFAULT_CAPTION = "关键帧"
REASON_SELECTED = "Semantic frame candidate scored by graph index matching."
REASON_OUTSIDE = "Frame is outside all transcript section windows."
REASON_DUPLICATE = "Rejected as a duplicate frame in transcript section windows."
REASON_MISSING_IMAGE = "Frame file is unavailable for semantic matching."
REASON_QUALITY_PASSED = "Passed local quality checks."
REASON_QUALITY_FAILED = "Rejected by local quality filter: {}."
# --- end of fixed values ----------------------------------------------------

# Rows of one ordered text or array aggregate. Longer groups continue in a
# further part, so no value grows with the size of a hot key.
PART_ROWS = 1_000

# Groups above this many rows take the split path of order-dependent operators.
HOT_GROUP_ROWS = 2_000_000
