"""Cuts and seconds of the k-way partitioner on grids, beside recursive straight cuts.

    python tools/grid_figures.py [SIDE ...]
"""

import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from plotweave.operators import kernels, kway  # noqa: E402


def straight(g: kernels.Graph, x, y, pop, members, parts: int, steps: int = 36) -> float:
    """The cut of recursive bisection by the sweep line."""
    if parts == 1:
        return 0.0
    sub, left_parts = kway.subgraph(g, members), -(-parts // 2)
    cuts = kernels.cut_candidates(x[members], y[members], pop[members], left_parts / parts, range(steps), steps, sub)
    best = kernels.choose_cut(cuts, float(pop[members].sum()), True)
    left = kernels.settle_sides(sub, kernels.side_mask(x[members], y[members], best.theta, best.threshold), pop[members])
    return best.length + straight(g, x, y, pop, members[left], left_parts, steps) + straight(
        g, x, y, pop, members[~left], parts - left_parts, steps)


def main() -> None:
    for side in [int(a) for a in sys.argv[1:]] or [100, 316]:
        at = np.arange(side * side).reshape(side, side)
        src = np.concatenate([at[:-1].ravel(), at[:, :-1].ravel()])
        dst = np.concatenate([at[1:].ravel(), at[:, 1:].ravel()])
        pop = np.random.default_rng(0).integers(1, 20, side * side)
        g = kernels.Graph(side * side, src, dst, np.ones(len(src)))
        x, y = (a.ravel() + 0.5 for a in np.divmod(np.arange(side * side), side))
        for k in (2, 9):
            began = time.monotonic()
            d = kway.partition(side * side, src, dst, np.ones(len(src)), pop, k)
            took = time.monotonic() - began
            line = straight(g, x, y, pop, np.arange(side * side), k) if side <= 400 else float("nan")
            print(f"{side * side} units, k={k}: k-way cut {g.cut(d):.0f} in {took:.1f} s, straight cuts {line:.0f}", flush=True)


if __name__ == "__main__":
    main()
