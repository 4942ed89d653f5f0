"""Hand-written markup of the shapes a map extract has."""

from __future__ import annotations

_STAMP = "2020-05-01T10:00:00Z"
# user name and id of every contributor
_ANN, _BEN, _CAT, _DAN = ("ann", 11), ("ben", 12), ("cat", 13), ("dan", 14)


def node(id_, who=_ANN, children=(), lat=1.5, lon=2.5) -> str:
    head = (f'<node id="{id_}" visible="true" version="2" changeset="7" timestamp="{_STAMP}"'
            f' user="{who[0]}" uid="{who[1]}" lat="{lat}" lon="{lon}"')
    return _closed(head, "node", children)


def way(id_, who=_ANN, children=()) -> str:
    head = (f'<way id="{id_}" visible="true" version="2" changeset="7" timestamp="{_STAMP}"'
            f' user="{who[0]}" uid="{who[1]}"')
    return _closed(head, "way", children)


def relation(id_, who=_ANN, children=()) -> str:
    head = (f'<relation id="{id_}" visible="true" version="2" changeset="7" timestamp="{_STAMP}"'
            f' user="{who[0]}" uid="{who[1]}"')
    return _closed(head, "relation", children)


def _closed(head, name, children) -> str:
    if not children:
        return head + "/>"
    return "\n  ".join([head + ">", *children]) + f"\n</{name}>"


def tag(k, v) -> str:
    return f'<tag k="{k}" v="{v}"/>'


def nd(ref) -> str:
    return f'<nd ref="{ref}"/>'


def member(kind, ref, role="") -> str:
    return f'<member type="{kind}" ref="{ref}" role="{role}"/>'


def document(*elements, bounds=True) -> str:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<map version="0.6" generator="by hand">']
    if bounds:
        head.append('<bounds minlat="0" minlon="0" maxlat="9" maxlon="9"/>')
    return "\n".join([*head, *elements, "</map>", ""])


def small() -> str:
    """A harbour: 3 paths before and between 7 points, 2 relations; 4 users; keys of all classes."""
    return document(
        way(71, _BEN, [tag("barrier", "wall"), nd(31), nd(33), tag("source:note", "survey & map".replace("&", "&amp;"))]),
        node(31, _ANN),
        node(32, _CAT, [tag("man_made", "crane"), tag("Height", "40 m")]),
        relation(90, _DAN, [tag("name", "Old Quay"), member("way", 71, "outer")]),
        node(33, _ANN, [tag("mooring", "yes")]),
        way(72, _BEN, [nd(32), nd(34), nd(35), tag("waterway", "dock"), nd(32)]),
        node(34, _ANN),
        node(35, _CAT),
        way(73, _CAT),
        node(36, _BEN, [tag("seamark:type", "light"), tag("light.colour", "red"), tag("ref", "7")]),
        node(37, _DAN),
        relation(91, _DAN, [member("node", 36), member("way", 72, "edge"), member("way", 73), member("relation", 90)]),
        bounds=False,
    )
