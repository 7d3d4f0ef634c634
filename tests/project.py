"""A small source tree with one of everything the scanner and the parsers treat."""

FILES = {
    "backend/src/OrderController.java": '''package demo;

import java.util.List;

/** class Fake { void no() {} } */
@RestController
@RequestMapping({"/api/orders", "/v2/orders"})
public class OrderController {
    private final OrderService service;
    @Autowired
    private StockService stock, other;
    private String text = "class Nope { }";

    public OrderController(OrderService service) {
        this.service = service;
    }

    @GetMapping("/{id}")
    public Order find(@PathVariable("id") Long id) {
        stock.touch(id);
        return service.findById(id);
    }

    @RequestMapping(value = "/search", method = {RequestMethod.POST, RequestMethod.PUT})
    public <T> List<T> search() { return service.all(helper.x()); }

    @PostMapping
    abstract void create();

    static class Inner {
        int size() { return 1; }
    }

    interface Port { void in(); }
}
''',
    "backend/src/OrderService.java": '''@Service
public class OrderService {
    public Order findById(Long id) { return null; }
    public List<Order> all(Object x) { return null; }
}

@Service
class StockService { void touch(Long id) { } }

enum Kind { A, B; }
''',
    "frontend/src/OrderView.vue": """<template><div/></template>
<script setup lang="ts">
import { API, save } from './api'
const one = axios.get(`/api/orders/${id}`)
http.post(API.search, { a: 1, b: "x, y" })
request({ url: API.both, method: 'get' })
save({ url: '/never' })
client.request({ url: "/api/orders/7", method: "DELETE" })
fetch(API.search, { method: 'PUT' })
fetch(dynamic)
axios({ url: '/plain' })
</script>
""",
    "frontend/src/api.ts": """export const API = { search: '/api/orders/search', both: '/a' }
export const save = (url) => { return http.post(url, "{") }
export const request = (config) => http.put(config.url)
""",
    "frontend/src/more.js": "const API = { both: '/b' }\n// axios.get('/commented')\nlet s = \"axios.get('/quoted')\"\n",
    "algorithm/detector.py": '''class Detector(Base, metaclass=M):
    """Doc."""

    @staticmethod
    def run(a, /, b=1, *rest, c, **more):
        def inner():
            pass
        return inner

    async def wait(self): ...


def top(): return Detector
''',
    "algorithm/broken.py": "def broken(:\n",
    "conf/app.yml": "a: 1\n",
    "node_modules/skip.js": "axios.get('/skipped')",
    "notes.txt": "unknown suffix",
}


def write(root):
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (root / "big.sql").write_bytes(b"x" * 5000)
    (root / "nul.json").write_bytes(b"{\0}")
    (root / "latin.xml").write_bytes(b"<a>\xe9</a>")
    (root / "bom.json").write_bytes(b"\xef\xbb\xbf{}\r\n{}\n")
    (root / "link.py").symlink_to(root / "algorithm/detector.py")
    return root
