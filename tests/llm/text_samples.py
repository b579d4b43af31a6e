"""Made-up texts for the tests of this folder."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % 20] + str((seed * 131 + i * 17) % 97) for i in range(n))
