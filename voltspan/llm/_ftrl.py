"""Follow-the-regularised-leader for sparse multinomial logistic regression with an elastic net."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights (features x classes); two classes or more. l1 sets weights to exactly zero, l2 shrinks them."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.weigh(self.z[index], self.n[index])

    def weigh(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p
        n = self.n[index]
        more = n + g * g
        self.z[index] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[index] = more


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-out labels are likeliest."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
