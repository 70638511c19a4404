"""The processing settings, their stages, defaults and identities."""

# Every stage with its setting keys, in menu order.
STAGES = {
    "white_balance": ["white_balance_temperature", "white_balance_tint"],
    "exposure": ["exposure"],
    "noise_reduction": ["noise_reduction", "neural_noise_reduction"],
    "tone": ["tone_blacks", "tone_shadows", "tone_dark_mids", "tone_midtones",
             "tone_light_mids", "tone_highlights", "tone_whites"],
    "optics": ["lens_correction", "lens_correction_strength", "chromatic_aberration_correction"],
    "film": ["lut_path", "lut_strength", "grain_amount", "grain_size"],
}
KEYS = [key for keys in STAGES.values() for key in keys]

# The order in which stages run.
EXECUTION_ORDER = ["white_balance", "exposure", "optics", "noise_reduction", "tone", "film"]

# Settings of a fresh project; keys not listed are 0.
DEFAULTS = {
    "white_balance_temperature": None, "noise_reduction": 0.35,
    "lens_correction": True, "lens_correction_strength": 1.0, "chromatic_aberration_correction": True,
    "lut_path": None, "lut_strength": 1.0, "grain_size": 1.0,
}
# Settings under which each stage passes pixels through; keys not listed are 0.
IDENTITY = {
    "white_balance_temperature": None,
    "lens_correction": False, "lens_correction_strength": 1.0, "chromatic_aberration_correction": False,
    "lut_path": None, "grain_size": 1.0,
}

FLAGS = {"lens_correction", "chromatic_aberration_correction"}
TEXTS = {"lut_path"}
NUMBERS = [key for key in KEYS if key not in FLAGS and key not in TEXTS]

# Accepted range per key; other numbers only need to be numbers.
RANGES = {**{key: (-2.0, 2.0) for key in STAGES["tone"]},
          "neural_noise_reduction": (0.0, 1.0), "lens_correction_strength": (0.0, 2.0)}

# Ranges a renderer accepts; a temperature of 0 or null means as shot.
RENDER_RANGES = {
    "white_balance_temperature": (2000.0, 50000.0), "white_balance_tint": (-20.0, 20.0), "exposure": (-10.0, 10.0),
    "noise_reduction": (0.0, 1.0), "neural_noise_reduction": (0.0, 1.0), "lut_strength": (0.0, 1.0),
    "grain_amount": (0.0, 1.0), "grain_size": (0.25, 16.0), "lens_correction_strength": (0.0, 2.0),
    **{key: (-2.0, 2.0) for key in STAGES["tone"]},
}
