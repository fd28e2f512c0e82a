"""Fixed values of the sensor and of the label set."""

# Frame shape.
BINS, WIDTH, HEIGHT = 700, 400, 512
# Metres per bin and the sensor's range offset.
METRES_PER_BIN = 10e-10 * 299792458 / 2
RANGE_OFFSET = 1.20
# Angles in degrees.
STEP_X, STEP_Y, TOP_Y = 0.1, 0.05, 25.6
# Gain of each block of 64 lines, after a shift of 4 lines.
BLOCK_GAINS = (8.0, 8.0, 4.0, 1.6, 1.0, 4.0, 8.0, 8.0)
BLOCK_LINES, BLOCK_SHIFT = 64, 4
# Labels.
LABELS = {0: "noise", 1: "object", 2: "glass", 3: "ghost", -1: "undefined"}
NOISE, OBJECT, GLASS, GHOST, UNDEFINED = 0, 1, 2, 3, -1
CLASSES = 4
