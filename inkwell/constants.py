"""Fixed values that results depend on."""

# Tolerance in pixels and lane kernel by level, and the default tolerance.
TOLERANCE = {"principiante": 8.0, "intermedio": 5.0, "avanzado": 3.0}
LANE_KERNEL = {"principiante": 7, "intermedio": 5, "avanzado": 3}
TOLERANCE_DEFAULT = 5.0

# Fidelity.
MAX_MEAN_ERROR = 12.0
WEIGHT_PRECISION = 0.65
WEIGHT_COVERAGE = 0.35

# Weights of the final score, which add up to 1.
WEIGHTS = {
    "dt_precision": 0.30,
    "dt_coverage": 0.20,
    "topology": 0.20,
    "ssim": 0.12,
    "procrustes": 0.10,
    "hausdorff": 0.04,
    "trajectory": 0.02,
    "cosine": 0.02,
}
TOPOLOGY_HIT, TOPOLOGY_MISS = 100.0, 30.0
TRAJECTORY_FACTOR = 3.0
HAUSDORFF_TOLERANCE, HAUSDORFF_FACTOR = 5.0, 2.0
UNDEFINED = 999.0

# Sizes.
CANVAS = 128
TRAJECTORY_POINTS = 64
PROCRUSTES_POINTS = 50
SEGMENTS = 12
BAND_RATIO = 0.25

# Feedback texts, as shown to teachers.
FEEDBACK_GOOD = "Excelente trazo."
FEEDBACK_FAIR = "Buen intento, sigue practicando."
FEEDBACK_POOR = "Necesitas practicar mas esta letra."
FEEDBACK_COVERAGE = "Parece que no completaste toda la letra."
FEEDBACK_PRECISION = "Intenta mantenerte dentro del carril de la letra."
FEEDBACK_TOPOLOGY = "Revisa los bucles o circulos de la letra (ej: el hueco de la 'A')."
FEEDBACK_HAUSDORFF = "Hay partes del trazo muy alejadas de la forma correcta."

# Detection.
CONFIDENCE = 0.55
AREA_RATIO = (0.0005, 0.60)
ASPECT_RATIO = (0.20, 5.0)
OVERLAP = 0.40
MAX_BOXES = 50
WORD_GAP = 1.5
LINE_TOLERANCE, LINE_LEAST = 0.35, 8.0
ANCHOR_TOLERANCE = 0.5

# Characters by kind.
LOWER = "abcdefghijklmnopqrstuvwxyzñ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÑ"
ACCENTED_LOWER = "áéíóúü"
ACCENTED_UPPER = "ÁÉÍÓÚÜ"
BASE_LOWER = "aeiouu"
BASE_UPPER = "AEIOUU"
DIGITS = "0123456789"
PUNCTUATION = ".,;:¿?¡!()-_'\"/@#$%&*+=<>"
STROKES = ("línea_vertical", "línea_horizontal", "línea_oblicua_derecha", "línea_oblicua_izquierda", "curva", "círculo")

# A character that is often read, and what may have been meant.
CONFUSIONS = {
    "¡": ("punct_vertical", "ijlr1"),
    "!": ("punct_vertical", "ijlr1"),
    "+": ("punct_cross", "tTH4"),
    "?": ("punct_curve", "23gs5"),
    "/": ("punct_slash", "l1Ii"),
    '"': ("punct_double", "nmHMh"),
    "'": ("punct_quote", "vri"),
    "<": ("punct_angle", "zZcv"),
    ">": ("punct_angle", "zZs"),
    "&": ("punct_complex", "8BS"),
    "#": ("punct_complex", "HM"),
    "$": ("punct_complex", "Ss5"),
    "_": ("punct_line", "-Ile"),
    ")": ("punct_paren", "ÁÜ,c"),
    "(": ("punct_paren", "CcG"),
    "-": ("punct_line", "_Il"),
    ",": ("punct_dot", ".9i"),
    ".": ("punct_dot", ",oc"),
    "p": ("round_letter", "bdq9P"),
    "P": ("round_letter", "BDRp"),
    "0": ("zero_oh", "OoQD"),
    "O": ("zero_oh", "0oQD"),
    "o": ("zero_oh", "0Oc"),
    "1": ("one_el", "lI7TZi"),
    "l": ("one_el", "1I!i|"),
    "I": ("one_el", "1li!-_"),
    "W": ("wide_letter", "wMN"),
    "w": ("wide_letter", "WM%"),
    "M": ("wide_letter", "WwNm"),
    "U": ("u_shape", "uVYJ"),
    "Y": ("u_shape", "UyV!"),
    "y": ("u_shape", "YUv!"),
    "ñ": ("tilde_letter", "nmh"),
    "Ñ": ("tilde_letter", "NMW"),
    "c": ("c_shape", "Ce(G"),
    "C": ("c_shape", "cG(Q"),
    "F": ("f_shape", "fET"),
    "E": ("f_shape", "FeÉ"),
    "á": ("accent", "a"),
    "é": ("accent", "e"),
    "í": ("accent", "i"),
    "ó": ("accent", "o06"),
    "ú": ("accent", "u"),
    "Á": ("accent", "A4"),
    "É": ("accent", "E"),
    "Í": ("accent", "I"),
    "Ó": ("accent", "O0"),
    "Ú": ("accent", "U"),
}

# Two-letter runs that no word has, beside every letter three times.
IMPOSSIBLE_PAIRS = ("kk", "ww", "yy", "zx", "xz", "qw", "wq", "zz", "xx", "vv", "jj", "qq", "jk", "kj", "zq", "qz")


def impossible_sequences() -> list[str]:
    """Every basic letter three times in a row, and the pairs above."""
    return [c * 3 for c in LOWER if c != "ñ"] + list(IMPOSSIBLE_PAIRS)


def ellipse_half_widths(radius: int) -> list[int]:
    """Half width of each row of an elliptic kernel, from the middle row outwards."""
    return [round(radius * ((radius**2 - d**2) / radius**2) ** 0.5) for d in range(radius + 1)]
