"""The API path normaliser as a plain function, for kernels and tests."""

import re

PARAMETER = re.compile(r"\{[^/{}]+\}|:[^/]+|\$\{[^/{}]+\}|\d+")


def normalize_api_path(url: str) -> str:
    path = re.sub(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "", url.strip())
    path = path.split("#", 1)[0].split("?", 1)[0]
    return "/" + "/".join("{param}" if PARAMETER.fullmatch(s) else s for s in path.split("/") if s)
