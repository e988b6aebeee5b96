"""Log-gamma and its derivatives for positive arguments, as SQL expression text (Spark SQL has none).

The argument is shifted up by a fixed number of steps with the recurrence, then the asymptotic series is
used; the relative error is below 1e-11. The text form keeps long formulas to one parsed expression each. The
``_value`` functions give the same for a float held by the driver.
"""

from __future__ import annotations

import math

_SHIFT = 8

# Coefficients of the asymptotic series in 1 / z^2.
_LGAMMA = ["1/12", "1/360", "1/1260", "1/1680", "1/1188"]
_DIGAMMA = ["1/12", "1/120", "1/252", "1/240", "1/132"]
_TRIGAMMA = ["1/6", "1/30", "1/42", "1/30", "5/66"]
_TETRAGAMMA = ["1/2", "1/6", "1/6", "3/10", "5/6"]


def _alternating(coefs: list[str], w: str) -> str:
    """c0 - w (c1 - w (c2 - ...)) in doubles."""
    text = ""
    for c in reversed(coefs):
        top, bottom = c.split("/")
        value = f"{top}D/{bottom}D"
        text = f"({value} - {w}*{text})" if text else f"({value})"
    return text


def lgamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    product = "*".join(f"({x} + {k}D)" for k in range(_SHIFT))
    series = _alternating(_LGAMMA, f"(1D/({z}*{z}))")
    return f"(({z} - 0.5D)*ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series}/{z} - ln({product}))"


def digamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    below = " + ".join(f"1D/({x} + {k}D)" for k in range(_SHIFT))
    return f"(ln({z}) - 0.5D/{z} - {_alternating(_DIGAMMA, f'(1D/({z}*{z}))')}/({z}*{z}) - ({below}))"


def trigamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    below = " + ".join(f"1D/(({x} + {k}D)*({x} + {k}D))" for k in range(_SHIFT))
    series = _alternating(_TRIGAMMA, f"(1D/({z}*{z}))")
    return f"(1D/{z} + 0.5D/({z}*{z}) + {series}/({z}*{z}*{z}) + ({below}))"


def tetragamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    below = " + ".join(f"2D/(({x} + {k}D)*({x} + {k}D)*({x} + {k}D))" for k in range(_SHIFT))
    series = _alternating(_TETRAGAMMA, f"(1D/({z}*{z}))")
    return f"(-1D/({z}*{z}) - 1D/({z}*{z}*{z}) - {series}/({z}*{z}*{z}*{z}) - ({below}))"


def digamma_value(x: float) -> float:
    z = x + _SHIFT
    series = sum((-1) ** i * _ratio(c) / z ** (2 * i + 2) for i, c in enumerate(_DIGAMMA))
    return math.log(z) - 0.5 / z - series - sum(1.0 / (x + k) for k in range(_SHIFT))


def trigamma_value(x: float) -> float:
    z = x + _SHIFT
    series = sum((-1) ** i * _ratio(c) / z ** (2 * i + 3) for i, c in enumerate(_TRIGAMMA))
    return 1.0 / z + 0.5 / z**2 + series + sum(1.0 / (x + k) ** 2 for k in range(_SHIFT))


def _ratio(text: str) -> float:
    top, bottom = text.split("/")
    return float(top) / float(bottom)
