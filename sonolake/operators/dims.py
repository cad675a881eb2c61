"""Fixed values of public standards, as dimension rows."""

# Channel order of five full-band channels, azimuths in degrees (left positive), loudness weights.
CHANNELS = [("L", 30.0, 1.0), ("C", 0.0, 1.0), ("R", -30.0, 1.0), ("SL", 110.0, 1.41), ("SR", -110.0, 1.41)]
# Delivery presets (name, target LKFS, tolerance LU, true-peak ceiling dBTP).
QC_PRESETS = [("ebu-r128-s2", -23.0, 1.0, -1.0), ("atsc-a85", -24.0, 2.0, -2.0), ("netflix", -27.0, 2.0, -2.0)]
# Legal bit rates in kbps.
BITRATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
# Rematrix bands (first, last bin).
REMATRIX_BANDS = [(13, 24), (25, 36), (37, 60), (61, 252)]
# Compression profiles (name, null band from, to, boost ratio, max boost, early cut ratio, early cut to, cut ratio), levels in dB.
DRC_PROFILES = [
    ("film-standard", -31.0, -26.0, 2.0, 6.0, 2.0, -16.0, 20.0),
    ("film-light", -41.0, -21.0, 2.0, 6.0, 2.0, -11.0, 20.0),
    ("music-standard", -31.0, -26.0, 2.0, 12.0, 2.0, -16.0, 20.0),
    ("music-light", -41.0, -21.0, 2.0, 12.0, 2.0, -11.0, 20.0),
    ("speech", -31.0, -26.0, 5.0, 15.0, 2.0, -16.0, 20.0),
]
# Coding modes (code, channels in order).
MODES = [(1, ["C"]), (2, ["L", "R"]), (3, ["L", "C", "R"]), (4, ["L", "R", "S"]), (5, ["L", "C", "R", "S"]), (6, ["L", "R", "SL", "SR"]), (7, ["L", "C", "R", "SL", "SR"])]
# Speaker locations by bit of a 16-bit map, most significant first; pairs count twice.
LOCATIONS = ["L", "C", "R", "Ls", "Rs", "Lc/Rc", "Lrs/Rrs", "Cs", "Ts", "Lsd/Rsd", "Lw/Rw", "Vhl/Vhr", "Vhc", "Lts/Rts", "LFE2", "LFE"]
PAIRS = 0x0676


def values(rows: list[tuple], columns: str) -> str:
    """A SQL relation of fixed rows."""
    lit = lambda v: "'" + v + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns}))"
