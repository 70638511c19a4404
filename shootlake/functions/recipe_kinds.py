"""Node kinds of a recipe, their parameters, ranges and defaults."""

from shootlake.functions.settings_keys import FLAGS, RANGES, RENDER_RANGES, STAGES, TEXTS

# Node kinds beyond the stages, in menu order, and the untyped container.
GRAPH_KINDS = ["blend", "color_subtract", "contrast", "sharpen", "crop", "rotate", "curves"]
KINDS = [*STAGES, *GRAPH_KINDS]
UNTYPED = "node"
SOURCE = 0
MAX_NODES = 64

# Kinds that may read a branch already in display space, and those that move the frame.
READS_DISPLAY = ["film", "crop", "rotate", UNTYPED]
KEEPS_DOMAIN = ["crop", "rotate", UNTYPED]
REFRAMES = ["crop", "rotate"]
# Kinds that a rule of wiring names, and a kind that stands for any while an insertion is tried.
TOLD_APART = ["optics", "film", "blend", "crop", "rotate"]
STAND_IN = "?"

# Accepted ranges of the parameters that only recipes have.
GRAPH_RANGES = {
    "color_subtract": {"red": (0.0, 4.0), "green": (0.0, 4.0), "blue": (0.0, 4.0)},
    "contrast": {"contrast": (0.2, 4.0), "pivot": (0.05, 0.95)},
    "sharpen": {"amount": (0.0, 3.0), "radius": (0.3, 5.0), "threshold": (0.0, 8.0)},
    "crop": {"left": (0.0, 1.0), "top": (0.0, 1.0), "width": (0.05, 1.0), "height": (0.05, 1.0), "angle": (-45.0, 45.0)},
    "rotate": {"quarter_turns": (0.0, 3.0)},
}
# Parameters a node falls back on; those not listed are 0.
GRAPH_DEFAULTS = {
    "color_subtract": {"red": 1.0, "green": 1.0, "blue": 1.0},
    "contrast": {"contrast": 1.0, "pivot": 0.435},
    "sharpen": {"amount": 0.0, "radius": 1.0, "threshold": 2.0},
    "crop": {"left": 0.0, "top": 0.0, "width": 1.0, "height": 1.0, "angle": 0.0},
    "rotate": {"quarter_turns": 0.0},
}
STAGE_DEFAULTS = {"lens_correction_strength": 1.0, "grain_size": 1.0}
CURVE_CHANNELS = ["red", "green", "blue", "master"]
IDENTITY_CURVE = [0.0, 0.0, 1.0, 1.0]
CURVE_POINTS = (2, 16)
CURVE_STEP = 0.001
CROP_SLACK = 1.0001
MAX = 1e308


def ranges(render: bool) -> dict[str, tuple[float, float]]:
    """`kind.key` to its range: what a project file accepts, or the narrower one a renderer does."""
    out = {f"{kind}.{key}": span for kind, keys in GRAPH_RANGES.items() for key, span in keys.items()}
    for stage, keys in STAGES.items():
        for key in keys:
            if key in TEXTS:
                continue
            if key in FLAGS:
                span = (0.0, 1.0)
            elif render:
                span = RENDER_RANGES[key]
            elif key == "white_balance_temperature":
                span = (5e-324, MAX)
            else:
                span = RANGES.get(key, (-MAX, MAX))
            out[f"{stage}.{key}"] = span
    return out
