"""Quantum circuits as gate lists, simulated on real amplitudes.

Every gate used is real, so a state is one double for each basis number. Circuits have few
qubits (a state of q qubits is 2 ** q numbers), so the state is built on the driver;
probabilities, marginals and averages over steps are tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A gate: name, target qubit (or two), controls as {qubit: bit}, angle.
Gate = tuple[str, tuple[int, ...], dict[int, int], float]
MOST_QUBITS = 20


def rotation_angles(distribution: Sequence[float], sine: bool = False) -> list[float]:
    """One angle for each depth of halving a distribution; at a depth, the last branch stands.

    ``sine``: the angle of the second half's share instead of the first half's."""
    angles: dict[int, float] = {}
    todo = [(0, list(distribution))]
    while todo:
        depth, part = todo.pop()
        if len(part) < 2:
            continue
        half = len(part) // 2
        first, second = sum(part[:half]), sum(part[half:])
        both = first + second
        share = 0.0 if both == 0 else (second if sine else first) / both
        angles[depth] = 0.0 if both == 0 else 2 * (math.asin if sine else math.acos)(math.sqrt(share))
        # A stack turns the order round, so the first half is put on last.
        todo += [(depth + 1, part[half:]), (depth + 1, part[:half])]
    return [angles[d] for d in sorted(angles)]


def initial_state(g: np.ndarray, alpha: float, sine: bool = False) -> tuple[list[Gate], int]:
    """Gates that load a transition matrix, and the qubits of a node: qubit 0 is the damping
    mark, then the current node, then the next."""
    nodes = g.shape[0]
    n = math.ceil(math.log2(nodes))
    current, following = range(1, 1 + n), range(1 + n, 1 + 2 * n)
    gates: list[Gate] = [("ry", (0,), {}, 2 * math.asin(math.sqrt(1 - alpha)))]
    gates += [("h", (q,), {}, 0.0) for q in current]
    for j in range(nodes):
        angles = rotation_angles(g[:, j], sine)
        if len(angles) != n:
            raise ValueError(f"column {j} has {len(angles)} angles for {n} qubits")
        # A control string is read from its last character: the node's lowest bit is at the
        # first current qubit, the mark at the front belongs to the damping qubit.
        here = {q: j >> k & 1 for k, q in enumerate(current)}
        gates += [("ry", (t,), here | {0: 0}, a) for t, a in zip(following, angles, strict=True)]
        gates += [("ry", (t,), here | {0: 1}, math.pi / 2) for t in following]
    return gates, n


def inverse(gates: list[Gate]) -> list[Gate]:
    return [(name, t, c, -a if name == "ry" else a) for name, t, c, a in reversed(gates)]


def reflection(init: list[Gate], qubits: int) -> list[Gate]:
    """The state's preparation undone, the sign of one basis state turned, and prepared again."""
    every = range(qubits)
    wall = [("h", (q,), {}, 0.0) for q in every] + [("x", (q,), {}, 0.0) for q in every]
    turn: list[Gate] = [("z", (qubits - 1,), {q: 1 for q in range(qubits - 1)}, 0.0)]
    return inverse(init) + wall + turn + wall[qubits:] + wall[:qubits] + init


def zero_reflection(init: list[Gate], qubits: int) -> list[Gate]:
    """The variant with a NOT on the last qubit where all others are 0."""
    wall: list[Gate] = [("h", (q,), {}, 0.0) for q in range(qubits)]
    return inverse(init) + wall + [("x", (qubits - 1,), {q: 0 for q in range(qubits - 1)}, 0.0)] + wall + init


def shift(n: int, first: int = 1) -> list[Gate]:
    """Current and next node exchanged."""
    return [("swap", (first + k, first + n + k), {}, 0.0) for k in range(n)]


def walk_circuit(g: np.ndarray, alpha: float = 0.85, steps: int = 2) -> tuple[list[Gate], int]:
    """Preparation and ``steps`` double rounds of reflection and shift; the gates and the qubits."""
    init, n = initial_state(g, alpha)
    once = reflection(init, 1 + 2 * n) + shift(n)
    return init + (once + once) * steps, 1 + 2 * n


def plain_circuit(g: np.ndarray, alpha: float = 0.85, steps: int = 2) -> tuple[list[Gate], int]:
    """The simpler circuit: uniform current node reflected about zero, one shift a step."""
    init, n = initial_state(g, alpha, sine=True)
    uniform: list[Gate] = [("h", (q,), {}, 0.0) for q in range(1, 1 + n)]
    wall = uniform
    turn: list[Gate] = [("x", (n,), {q: 0 for q in range(1, n)}, 0.0)]
    step = inverse(uniform) + wall + turn + wall + uniform + shift(n)
    return init + step * steps, 1 + 2 * n


def simulate(gates: list[Gate], qubits: int) -> np.ndarray:
    """Amplitudes from the zero state; qubit k is bit k of a basis number."""
    if qubits > MOST_QUBITS:
        raise ValueError(f"{qubits} qubits are more than {MOST_QUBITS}")
    state = np.zeros(1 << qubits)
    state[0] = 1.0
    basis = np.arange(1 << qubits)
    for name, targets, controls, angle in gates:
        open_ = np.ones(len(basis), bool)
        for q, bit in controls.items():
            open_ &= (basis >> q & 1) == bit
        if name == "swap":
            a, b = targets
            low = basis[open_ & ((basis >> a & 1) == 1) & ((basis >> b & 1) == 0)]
            high = low ^ (1 << a) ^ (1 << b)
            state[low], state[high] = state[high], state[low].copy()
            continue
        zero = basis[open_ & ((basis >> targets[0] & 1) == 0)]
        one = zero | 1 << targets[0]
        x, y = state[zero], state[one]
        c, s = math.cos(angle / 2), math.sin(angle / 2)
        r = math.sqrt(0.5)
        m = {"ry": (c, -s, s, c), "h": (r, r, r, -r), "x": (0, 1, 1, 0), "z": (1, 0, 0, -1)}[name]
        state[zero], state[one] = m[0] * x + m[1] * y, m[2] * x + m[3] * y
    return state


def state_table(spark: SparkSession, gates: list[Gate], qubits: int) -> DataFrame:
    """(basis, amp) of the simulated state, cells of no amplitude left out."""
    state = simulate(gates, qubits)
    return spark.createDataFrame([(k, float(a)) for k, a in enumerate(state) if abs(a) > 1e-15], "basis long, amp double")


def marginal(state: DataFrame, bits: Sequence[int]) -> DataFrame:
    """(node, prob): probabilities of the named qubits, the first being the highest bit of node."""
    node = F.lit(0).cast("long")
    for q in bits:
        node = F.shiftleft(node, 1) + F.shiftright(F.col("basis"), q).bitwiseAND(F.lit(1))
    return state.groupBy(node.alias("node")).agg(F.sum(F.col("amp") * F.col("amp")).alias("prob"))


def running_average(shots: DataFrame) -> DataFrame:
    """(step, node, average, delta) of (step, node, prob): means so far and their change; the
    first delta is the mean itself."""
    w = Window.partitionBy("node").orderBy("step")
    average = F.avg("prob").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = shots.withColumn("average", average)
    return out.select("step", "node", "average", (F.col("average") - F.coalesce(F.lag("average").over(w), F.lit(0.0))).alias("delta"))
