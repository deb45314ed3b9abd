"""Resolution and cleaning of urls against a base, which no built-in expression does."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

# Fixed values.
TRACKING = re.compile(r"(?i)(?:utm_.+|fbclid|gclid|dclid|mc_cid|mc_eid)")
PROTOCOLS, LIMIT = ("http", "https", "mailto", "file"), 4096
PORTS = {"http": 80, "https": 443}


def length16(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s) if s and not s.isascii() else len(s)


def cut16(s: str, n: int) -> str:
    """The first ``n`` UTF-16 units; half a pair at the end is left out."""
    return s[:n] if s.isascii() or length16(s) <= n or max(s) <= "\uffff" else s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")


def _dots(path: str) -> str:
    """Dot segments resolved."""
    out = []
    parts = path.split("/")
    for k, x in enumerate(parts):
        if x in ("..", "%2e%2e", "%2E%2E", ".%2e", "%2e."):
            if len(out) > 1:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        elif x in (".", "%2e", "%2E"):
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(x)
    return "/".join(out)


def resolve(value: str, base: str) -> tuple[str, str, str, str, str] | None:
    """(scheme, host and port, path, query, fragment) of a url as a browser writes it, without credentials; null if it has no meaning."""
    value = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
    try:
        if re.match(r"(?i)(https?|file):", value) or not re.match(r"(?i)[a-z][a-z0-9+.-]*:", value):
            value = value.replace("\\", "/")
        if m := re.match(r"(?i)(https?):(?!//)/?(?=[^/])", value):
            value = f"{m[1]}://{value[m.end():]}"
        elif re.match(r"(?i)file:(?!//)", value):
            value = "file://" + ("" if value[5:6] == "/" else "/") + value[5:]
        x = urlsplit(urljoin(base, value))
        scheme = x.scheme.lower()
        if not scheme:
            return None
        if scheme not in ("http", "https", "file", "ftp", "ws", "wss"):
            return scheme, "", quote(x.path, safe="/%:@!$&'()*+,;=~[]|^`{}\" <>"), x.query, x.fragment
        host = (x.hostname or "").lower()
        if scheme != "file" and (not host or re.search(r"[\s<>^|%#]", host)):
            return None
        if not host.isascii():
            host = host.encode("idna").decode()
        if ":" in host:
            host = f"[{host}]"
        if x.port is not None and x.port != PORTS.get(scheme):
            host += f":{x.port}"
        path = quote(_dots(x.path or "/"), safe="/%:@!$&'()*+,;=~[]|^")
        return scheme, host, path, quote(x.query, safe="/%:@!$&()*+,;=~[]|^`{}?"), quote(x.fragment, safe="/%:@!$&'()*+,;=~[]|^{}?#")
    except (ValueError, UnicodeError):
        return None


def href(x: tuple[str, str, str, str, str]) -> str:
    scheme, host, path, query, fragment = x
    front = f"{scheme}://{host}{path}" if scheme in ("http", "https", "file", "ftp", "ws", "wss") else f"{scheme}:{path}"
    return front + (f"?{query}" if query else "") + (f"#{fragment}" if fragment else "")


def safe_url(value: str, base: str) -> str | None:
    """The absolute url without credentials and tracking parameters, at most 4,096 UTF-16 units; null for other protocols."""
    x = resolve(value, base)
    if x is None or x[0] not in PROTOCOLS:
        return None
    scheme, host, path, query, fragment = x
    pairs = parse_qsl(query, keep_blank_values=True, errors="replace")
    rest = [(k, v) for k, v in pairs if not TRACKING.fullmatch(k)]
    # A query is only written anew where something is taken from it.
    if len(rest) < len(pairs):
        query = "&".join(f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}" for k, v in rest)
    return cut16(href((scheme, host, path, query, fragment)), LIMIT)


def asset_url(value: str) -> str | None:
    """An http(s) url without credentials, query and fragment."""
    x = resolve(value, "")
    return cut16(href((*x[:3], "", "")), LIMIT) if x and x[0] in PORTS else None
