"""Addresses and networks as text."""

from __future__ import annotations

_NAMES = ("broadcast", "host", "hostmask", "masklen", "netmask", "network", "family", "abbrev")
MACROS = {
    **{k: (lambda x, k=k: f"pm_inet_{k}({x})") for k in _NAMES},
    "inet_merge": lambda a, b: f"pm_inet_merge({a}, {b})",
    "inet_same_family": lambda a, b: f"(pm_inet_family({a}) = pm_inet_family({b}))",
    "set_masklen": lambda a, n: f"concat(pm_inet_host({a}), '/', {n})",
    "inet_subnet_contained_by_or_equals": lambda a, b: f"pm_inet_within({a}, {b})",
    "inet_subnet_contains_or_equals": lambda a, b: f"pm_inet_within({b}, {a})",
    "macaddr8_set7bit": lambda m: f"concat(lower(lpad(hex(CAST(conv(substring({m}, 1, 2), 16, 10) AS INT) | 2), 2, '0')), CASE WHEN char_length({m}) = 17 THEN concat(substring({m}, 3, 6), ':ff:fe', substring({m}, 9)) ELSE substring({m}, 3) END)",
}


def udfs():
    import ipaddress

    from ._udf import elementwise

    face = ipaddress.ip_interface

    def merge(a, b):
        x, y = face(a).network, face(b).network
        while not (x.supernet_of(y)):
            x = x.supernet()
        return str(x)

    return {
        "pm_inet_broadcast": elementwise(lambda x: f"{face(x).network.broadcast_address}/{face(x).network.prefixlen}", "string"), "pm_inet_host": elementwise(lambda x: str(face(x).ip), "string"), "pm_inet_hostmask": elementwise(lambda x: str(face(x).network.hostmask), "string"), "pm_inet_masklen": elementwise(lambda x: face(x).network.prefixlen, "int"), "pm_inet_netmask": elementwise(lambda x: str(face(x).network.netmask), "string"),
        "pm_inet_network": elementwise(lambda x: str(face(x).network), "string"), "pm_inet_family": elementwise(lambda x: face(x).version, "int"), "pm_inet_abbrev": elementwise(lambda x: str(face(x)) if "/" in x else str(face(x).ip), "string"), "pm_inet_merge": elementwise(merge, "string"), "pm_inet_within": elementwise(lambda a, b: face(a).network.subnet_of(face(b).network), "boolean"),
    }
