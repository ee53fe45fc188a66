"""Made-up prose for small tests."""

import random

PROSE = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + (str(r.randrange(9)) if r.random() < 0.5 else "") for _ in range(n))
