"""Min-cost flow for resharding: a transport problem between old and new shards."""

from __future__ import annotations


def transfers(sizes: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes to send from old shard i to new shard j, at the least total cost.

    Successive shortest paths over the residual network, found by Bellman-Ford. The
    totals must agree. The network has one vertex for each shard, not for each row,
    so it is solved on the driver.
    """
    if sum(sizes) != sum(capacities):
        raise ValueError("capacities must add up to the sizes")
    n, m = len(sizes), len(capacities)
    flow: dict[tuple[int, int], int] = {}
    supply, room = list(sizes), list(capacities)
    for i in range(n):  # an arc of cost 0 carries what it can: no cheaper path exists
        for j in range(m):
            if cost(i, j) == 0 and (x := min(supply[i], room[j])):
                flow[i, j] = flow.get((i, j), 0) + x
                supply[i] -= x
                room[j] -= x
    while any(supply):
        far = float("inf")
        dist_old = [0 if supply[i] else far for i in range(n)]
        dist_new = [far] * m
        came_new: list[int | None] = [None] * m
        came_old: list[int | None] = [None] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist_old[i] + cost(i, j) < dist_new[j]:
                        dist_new[j], came_new[j], changed = dist_old[i] + cost(i, j), i, True
            for (i, j), x in flow.items():
                if x and dist_new[j] - cost(i, j) < dist_old[i]:
                    dist_old[i], came_old[i], changed = dist_new[j] - cost(i, j), j, True
        j = min((j for j in range(m) if room[j]), key=lambda j: (dist_new[j], j))
        # Arcs as short as the shortest path are shortest paths themselves: all of them at once spare a search for each.
        short, any_direct = dist_new[j], False
        for b in range(m):
            for i in range(n):
                if supply[i] and room[b] and cost(i, b) == short:
                    x, any_direct = min(supply[i], room[b]), True
                    flow[i, b] = flow.get((i, b), 0) + x
                    supply[i] -= x
                    room[b] -= x
        if any_direct:
            continue
        path, end = [], j
        while True:
            i = came_new[end]
            path.append((i, end, 1))
            if came_old[i] is None:
                break
            path.append((i, came_old[i], -1))
            end = came_old[i]
        x = min(supply[i], room[j], *(flow[a, b] for a, b, sign in path if sign < 0), supply[i])
        for a, b, sign in path:
            flow[a, b] = flow.get((a, b), 0) + sign * x
        supply[i] -= x
        room[j] -= x
    return {k: x for k, x in flow.items() if x}


def even(total: int, parts: int) -> list[int]:
    """``total`` in ``parts`` whole shares at most one apart."""
    return [total // parts + (k < total % parts) for k in range(parts)]
