"""Minimum-cost assignment of rows to columns, by shortest augmenting paths on numpy."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of a one-to-one assignment of least total cost; the shorter side is matched in full.

    Takes n * n * m steps for n <= m. Rows come in ascending order.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.empty(0, int), np.empty(0, int)
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    cheapest = cost.argmin(axis=1)
    if len(set(cheapest.tolist())) == n:  # no assignment can cost less than each row's least
        return np.arange(n), cheapest
    row_price, column_price, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        distance, came_from, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, reach = start, -1, 0.0
        while True:
            slack = reach + cost[row] - row_price[row] - column_price
            closer = ~done & (slack < distance)
            distance[closer], came_from[closer] = slack[closer], column
            open_distance = np.where(done, np.inf, distance)
            column = int(open_distance.argmin())
            reach = open_distance[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        row_price[start] += reach
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                row_price[row_of[j]] += reach - distance[j]
            column_price[j] -= reach - distance[j]
        while column >= 0:
            before = came_from[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    columns = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[columns])
    return row_of[columns][order], columns[order]
