"""Response families: log-likelihood of one row and its derivatives in the linear predictor.

The terms are SQL text in the columns ``y`` and ``eta``, in steps that may use the columns of the steps
before. ``score`` and ``weight`` are the first and the negative second derivative, ``weight_eta`` the
derivative of the weight. The ``d_`` terms are derivatives in the log of the dispersion parameter (theta for
nb2, phi for nb1, the residual standard deviation for gaussian).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.special import digamma, digamma_value, lgamma, tetragamma, trigamma

HAS_DISPERSION = {"poisson": False, "nb2": True, "nb1": True, "gaussian": True}
LOG_LINK = {"poisson": True, "nb2": True, "nb1": True, "gaussian": False}


DERIVED = ("loglik", "score", "weight", "weight_eta", "d_loglik", "d_score", "d_weight")


def num(x: float) -> str:
    """A double literal in SQL text."""
    return "CAST('Infinity' AS DOUBLE)" if math.isinf(x) else f"({float(x)!r}D)"


def constants(family: str, log_disp: float) -> dict[str, float]:
    """What the row terms take from the log of the dispersion parameter."""
    if family == "gaussian":
        return {"c_inv": math.exp(-2.0 * log_disp), "c_base": -log_disp - 0.5 * math.log(2.0 * math.pi)}
    if family == "nb2":
        theta = math.exp(log_disp)
        return {"c_theta": theta, "c_const": theta * log_disp - math.lgamma(theta), "c_slope": log_disp + 1.0 - digamma_value(theta)}
    if family == "nb1":
        phi = math.exp(log_disp)
        log1 = math.log1p(phi)
        return {"c_per": 1.0 / phi, "c_log1": log1, "c_pull": phi / (1.0 + phi), "c_lift": log_disp - log1, "c_zero": 1.0 / (1.0 + phi)}
    return {}


def row_terms(family: str, log_disp: float | None = None) -> list[dict[str, str]]:
    """Steps that end with the columns ``DERIVED``; the log-likelihood is complete, constants included.

    Without ``log_disp`` the rows have the names of ``constants`` as columns, so the text is the same for all values.
    """
    c = {name: name if log_disp is None else num(value) for name, value in constants(family, log_disp or 0.0).items()}
    if family == "gaussian":
        inv = c["c_inv"]
        return [{"e": "y - eta"}, {
            "loglik": f"{c['c_base']} - 0.5D*e*e*{inv}",
            "score": f"e*{inv}", "weight": inv, "weight_eta": "0D",
            "d_loglik": f"e*e*{inv} - 1D", "d_score": f"-2D*e*{inv}", "d_weight": f"-2D*{inv}",
        }]
    factorial = lgamma("(y + 1D)")
    if family == "poisson":
        return [{"mu": "exp(eta)"}, {
            "loglik": f"y*eta - mu - {factorial}", "score": "y - mu", "weight": "mu", "weight_eta": "mu",
            "d_loglik": "0D", "d_score": "0D", "d_weight": "0D",
        }]
    if family == "nb2":
        theta, const, slope = c["c_theta"], c["c_const"], c["c_slope"]
        return [
            {"total": f"exp(eta) + {theta}", "size": f"y + {theta}"},
            {"q": f"1D - {theta}/total", "logtotal": "ln(total)"},
            {"curve": "q*(1D - q)"},
            {"tilt": "size*(1D - 2D*q)*curve"},
            {
                "loglik": f"{lgamma('size')} + {const} - {factorial} + y*eta - size*logtotal",
                "score": "y - size*q", "weight": "size*curve", "weight_eta": "tilt",
                "d_loglik": f"{theta}*({digamma('size')} + {slope} - logtotal - size/total)",
                "d_score": f"size*curve - {theta}*q", "d_weight": f"{theta}*curve - tilt",
            },
        ]
    if family == "nb1":
        log1 = c["c_log1"]
        return [
            {"r": f"exp(eta)*{c['c_per']}"},
            {
                "psi0": f"r*({digamma('(y + r)')} - {digamma('r')} - {log1})",
                "psi1": f"r*r*({trigamma('(y + r)')} - {trigamma('r')})",
                "psi2": f"r*r*r*({tetragamma('(y + r)')} - {tetragamma('r')})",
                "pull": f"r*{c['c_pull']}",
                "loglik": f"{lgamma('(y + r)')} - {lgamma('r')} - {factorial} + y*{c['c_lift']} - r*{log1}",
            },
            {"score": "psi0", "weight": "-(psi0 + psi1)", "weight_eta": "-(psi0 + 3D*psi1 + psi2)", "loglik": "loglik",
             "pull": "pull", "d_loglik": f"y*{c['c_zero']} - psi0 - pull"},
            {"d_score": "weight - pull", "d_weight": "pull - weight_eta"},
        ]
    raise ValueError(f"unknown family {family}")


def mean_of(family: str, eta: Column) -> Column:
    return F.exp(eta) if LOG_LINK[family] else eta


def variance_of(family: str, mu: Column, dispersion: float | None) -> Column:
    if family == "poisson":
        return mu
    if family == "nb2":
        return mu + mu * mu / F.lit(dispersion)
    if family == "nb1":
        return mu * F.lit(1.0 + dispersion)
    return F.lit(float(dispersion) ** 2)


def zero_probability(family: str, mu: Column, dispersion: float | None) -> Column:
    """P(Y = 0 | mu)."""
    if family == "poisson":
        return F.exp(-mu)
    if family == "nb2":
        return F.pow(F.lit(dispersion) / (mu + F.lit(dispersion)), F.lit(dispersion))
    if family == "nb1":
        return F.pow(F.lit(1.0 + dispersion), -mu / F.lit(dispersion))
    raise ValueError("zero probability is for count families")


def next_count(family: str, dispersion: float | None) -> Callable[[Column, Column], Column]:
    """ln P(k) - ln P(k - 1) as a function of the linear predictor and k."""
    if family == "poisson":
        return lambda eta, k: eta - F.log(k)
    if family == "nb2":
        theta = F.lit(float(dispersion))
        return lambda eta, k: F.log((k - 1 + theta) / k) + eta - F.log(F.exp(eta) + theta)
    if family == "nb1":
        phi = float(dispersion)
        return lambda eta, k: F.log((k - 1 + F.exp(eta) / F.lit(phi)) / k) + F.lit(math.log(phi) - math.log1p(phi))
    raise ValueError("expected counts are for count families")
