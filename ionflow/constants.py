"""Masses, adducts, neutral losses and names of statuses."""

# Monoisotopic masses in the order of formula vectors.
ELEMENTS = ("C", "H", "N", "O", "P", "S", "F", "Cl", "Br", "I")
MASS = {
    "C": 12.0,
    "H": 1.00782503223,
    "N": 14.00307400443,
    "O": 15.99491461957,
    "P": 30.97376199842,
    "S": 31.9720711744,
    "F": 18.99840316273,
    "Cl": 34.968852682,
    "Br": 78.9183376,
    "I": 126.9044719,
    "Na": 22.9897692820,
    "K": 38.9637064864,
}
ELECTRON = 0.000548579909065
#: Elements of ion vectors: the ten and the two metals of adducts.
ION_ELEMENTS = (*ELEMENTS, "Na", "K")

# Adduct, change of composition, charge.
ADDUCTS = (
    ("[M+H]+", {"H": 1}, 1),
    ("[M+NH4]+", {"N": 1, "H": 4}, 1),
    ("[M-H2O+H]+", {"H": -1, "O": -1}, 1),
    ("[M-2H2O+H]+", {"H": -3, "O": -2}, 1),
    ("[M+Na]+", {"Na": 1}, 1),
    ("[M+K]+", {"K": 1}, 1),
    ("[M-H]-", {"H": -1}, -1),
    ("[M-H2O-H]-", {"H": -3, "O": -1}, -1),
    ("[M+CH2O2-H]-", {"C": 1, "H": 1, "O": 2}, -1),
    ("[M+Cl]-", {"Cl": 1}, -1),
)
# Neutral losses counted as evidence.
LOSSES = (("water", {"H": 2, "O": 1}), ("co", {"C": 1, "O": 1}), ("co2", {"C": 1, "O": 2}), ("ammonia", {"N": 1, "H": 3}))
# Default element limits.
LIMITS = {"C": 155, "H": 268, "N": 35, "O": 65, "P": 4, "S": 8, "F": 44, "Cl": 8, "Br": 8, "I": 8}
# Order of elements in a formula string, with and without carbon.
HILL = ("C", "H", "Br", "Cl", "F", "I", "N", "O", "P", "S")
ALPHABETICAL = ("Br", "C", "Cl", "F", "H", "I", "N", "O", "P", "S")
# Statuses of predictions and reasons of rejection, the first that holds.
STATUSES = ("ok", "truncated", "no_candidates", "invalid_input", "unsupported_input", "resource_limit")
REASONS = ("missing_structure_id", "conflicting_structure", "unsupported_formula", "unsupported_adduct", "invalid_ion_composition", "precursor_error_gt20ppm", "invalid_spectrum")


def shift(delta: dict[str, int], charge: int) -> float:
    """What an adduct adds to a neutral mass."""
    return sum(MASS[e] * n for e, n in delta.items()) - charge * ELECTRON
