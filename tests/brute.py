"""Plain Python answers for small inputs."""

from __future__ import annotations

from math import sqrt


def distance(a, b, numeric, nominal):
    total = sum((a[c] - b[c]) ** 2 for c in numeric) + sum(a[c] != b[c] for c in nominal)
    return sqrt(total)


def window_status(points, width, slide, radius, k, numeric, nominal=()):
    """{(window, seq): (succ, prev, status)} of points given in order."""
    panes, result = width // slide, {}
    for w in range(panes - 1, len(points) // slide):
        members = range((w - panes + 1) * slide, (w + 1) * slide)
        for i in members:
            near = [j for j in members if j != i and distance(points[i], points[j], numeric, nominal) <= radius]
            succ = sum(j // slide >= i // slide for j in near)
            prev = len(near) - succ
            status = "Safe" if succ >= k else "Unsafe" if succ + prev >= k else "Outlier"
            result[w, i + 1] = (succ, prev, status)
    return result


def timeline(points, width, radius, k, numeric, nominal=()):
    """Status changes of each point, by walking through all positions."""
    changes = set()
    for i in range(len(points)):
        last = None
        for t in range(i, min(len(points), i + width)):
            near = [
                j for j in range(max(0, t - width + 1), t + 1)
                if j != i and distance(points[i], points[j], numeric, nominal) <= radius
            ]
            succ = sum(j > i for j in near)
            prev = len(near) - succ
            status = "Safe" if succ >= k else "Unsafe" if succ + prev >= k else "Outlier"
            if status != last:
                changes.add((i + 1, t + 1, succ, prev, status))
            last = status
    return changes


def close_pairs(rows, key, radius, numeric, nominal=()):
    return {
        (a[key], b[key]) for a in rows for b in rows
        if a[key] != b[key] and distance(a, b, numeric, nominal) <= radius
    }


def box_pairs(boxes):
    return {
        (a[0], b[0]) for a in boxes for b in boxes
        if a[0] != b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    }
