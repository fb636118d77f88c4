"""Pairwise preference losses as column expressions (L1-L18) and the maps of divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vectors import log_sigmoid, sigmoid


def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _square(x: Column) -> Column:
    return x * x


def divergence(r: Column, kind: str = "reverse_kl", alpha: float = 0.5, cap: float = 80.0) -> Column:
    """The score that a log-ratio has under a divergence."""
    if kind == "reverse_kl":
        return r
    if kind == "forward_kl":
        return -F.exp(-r)
    if kind == "js_divergence":
        return log_sigmoid(r)
    if kind == "alpha_divergence":
        if abs(alpha - 1) < 1e-6:
            return r
        return F.exp(F.least((alpha - 1) * r, F.lit(cap))) / (alpha - 1)
    raise ValueError(f"unknown divergence {kind!r}")


def _robust(beta, eps, d):
    return ((1 - eps) * -log_sigmoid(beta * d) + eps * log_sigmoid(-beta * d)) / (1 - 2 * eps)


def _exo(beta, eps, d):
    if eps <= 0:
        raise ValueError("exo_pair needs label smoothing above 0")
    lw, ll = log_sigmoid(beta * d), log_sigmoid(-beta * d)
    return F.exp(lw) * (lw - F.log1p(F.lit(-eps))) + F.exp(ll) * (ll - F.log(F.lit(eps)))


def _discopop(beta, tau, d):
    m = sigmoid(beta * d / tau)
    return -log_sigmoid(beta * d) * (1 - m) + F.exp(-beta * d) * m


#: name -> loss of the scores cs, rs, completion lengths nc, nr, beta, smoothing eps and temperature tau; those of
#: RATIO_LOSSES also take the log-ratios cr, rr that the scores come from by a divergence.
LOSSES = {
    "sigmoid": lambda cs, rs, nc, nr, b, eps, tau: -log_sigmoid(b * (cs - rs)),
    "hinge": lambda cs, rs, nc, nr, b, eps, tau: _relu(1 - b * (cs - rs)),
    "ipo": lambda cs, rs, nc, nr, b, eps, tau: _square(cs / F.greatest(nc, F.lit(1)) - rs / F.greatest(nr, F.lit(1)) - 1 / (2 * b)),
    "robust": lambda cs, rs, nc, nr, b, eps, tau: _robust(b, eps, cs - rs),
    "exo_pair": lambda cs, rs, nc, nr, b, eps, tau: _exo(b, eps, cs - rs),
    "nca_pair": lambda cs, rs, nc, nr, b, eps, tau: -log_sigmoid(b * cs) - 0.5 * log_sigmoid(-b * cs) - 0.5 * log_sigmoid(-b * rs),
    "bco_pair": lambda cs, rs, nc, nr, b, eps, tau: -log_sigmoid(b * cs) - log_sigmoid(-b * rs),
    "sppo_hard": lambda cs, rs, nc, nr, b, eps, tau: _square(cs - 0.5 / b) + _square(rs + 0.5 / b),
    "apo_zero": lambda cs, rs, nc, nr, b, eps, tau, cr, rr: 1 - sigmoid(b * cr) + sigmoid(b * rr),
    "apo_down": lambda cs, rs, nc, nr, b, eps, tau, cr, rr: sigmoid(b * cr) + 1 - sigmoid(b * (cs - rs)),
    "discopop": lambda cs, rs, nc, nr, b, eps, tau: _discopop(b, tau, cs - rs),
}


RATIO_LOSSES = ("apo_zero", "apo_down")


def loss(
    name: str, cs: Column, rs: Column, nc: Column, nr: Column, beta: float = 0.1, eps: float = 0.1, tau: float = 0.05, cr: Column | None = None, rr: Column | None = None
) -> Column:
    """One loss; *cr* and *rr* are the log-ratios where the scores are not (reverse KL: they are)."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(LOSSES)}")
    ratios = (cs if cr is None else cr, rs if rr is None else rr) if name in RATIO_LOSSES else ()
    return LOSSES[name](cs, rs, nc, nr, beta, eps, tau, *ratios)


def smoothed(x: Column, eps: float = 0.0) -> Column:
    """The label-smoothed logistic loss that the sort-matched losses share."""
    return -log_sigmoid(x) * (1 - eps) - log_sigmoid(-x) * eps


def tdpo(margin: Column, kl_chosen: Column, kl_rejected: Column, beta: float = 0.1, alpha: float = 1.0) -> Column:
    """L16 with alpha 1, L17 otherwise (alpha 0: no KL); the value is that without stopped gradients."""
    return -log_sigmoid(beta * (margin - alpha * (kl_rejected - kl_chosen)))


def simpo(chosen_mean: Column, rejected_mean: Column, beta: float = 10.0, gamma: float = 3.0) -> Column:
    """Beta times the margin of the mean log-probabilities, less the target margin gamma."""
    return -log_sigmoid(beta * (chosen_mean - rejected_mean) - gamma)


def kto(ratio: Column, desirable: Column, kl: Column, beta: float = 0.1, desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> Column:
    """The prospect loss of one labelled completion against the batch's KL estimate, which never falls below 0."""
    base = F.greatest(kl, F.lit(0.0))
    return F.when(desirable, desirable_weight * (1 - sigmoid(beta * (ratio - base)))).otherwise(undesirable_weight * (1 - sigmoid(beta * (base - ratio))))
