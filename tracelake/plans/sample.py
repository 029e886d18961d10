"""A small project as literal sources, and larger ones of the same make: domains of a controller, service, mapper and record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (path, text) of a ticket desk: two endpoints over an interface with one implementation, a mapper, a record, and a nightly script.
DESK = (
    (
        "shop/TicketDesk.java",
        """package shop;
@RestController @RequestMapping("/desk")
public class TicketDesk {
    @Autowired private TicketBook book;
    @PostMapping("/tickets") public int open(@RequestParam("holder") String holder, @RequestParam("seat") int seat) {
        Ticket t = new Ticket();
        t.setHolder(holder.trim());
        if (seat > 100) { return book.reject(holder); }
        return book.save(t);
    }
    @GetMapping("/holder") public String holder(@RequestParam("code") String code) { return book.holderOf(code); }
}
""",
    ),
    ("shop/Ticket.java", "package shop;\npublic class Ticket {\n    private String holder;\n    public void setHolder(String v) { this.holder = v; }\n    public String getHolder() { return holder; }\n}\n"),
    ("shop/TicketBook.java", "package shop;\npublic interface TicketBook { int save(Ticket t); int reject(String who); String holderOf(String code); }\n"),
    (
        "shop/PaperBook.java",
        """package shop;
@Service
public class PaperBook implements TicketBook {
    private final TicketRows rows;
    public PaperBook(TicketRows rows) { this.rows = rows; }
    public int save(Ticket t) { return rows.insert(t); }
    public int reject(String who) { return 0; }
    public String holderOf(String code) { String c = clean(code, 3); return rows.find(c); }
    String clean(String s, int n) { if (n <= 0) { return s; } return clean(s, n - 1); }
}
""",
    ),
    ("shop/TicketRows.java", "package shop;\n@Mapper\npublic interface TicketRows { int insert(Ticket t); String find(String code); }\n"),
    (
        "shop/TicketRows.xml",
        """<?xml version="1.0"?>
<mapper namespace="shop.TicketRows">
  <insert id="insert">INSERT INTO TICKET (HOLDER) VALUES (#{holder})</insert>
  <select id="find" resultType="string">SELECT HOLDER FROM TICKET <where><if test="code != null">CODE = #{code}</if></where></select>
</mapper>
""",
    ),
    ("night.sql", "INSERT INTO ARCHIVE (NAME) SELECT HOLDER FROM TICKET WHERE STATE = 'X';\n"),
)


def sources(spark: SparkSession, texts=DESK) -> DataFrame:
    """(file_id, kind, path, text, content, sha256) of literal sources, as files.source_files() gives them."""
    kinds = {"java": 0, "xml": 1, "sql": 2}
    rows = sorted(((p.rsplit(".", 1)[1], p, t) for p, t in texts), key=lambda r: (kinds[r[0]], r[1].rpartition("/")[::2]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id int, kind string, path string, text string")
    return df.withColumn("content", F.encode("text", "UTF-8")).withColumn("sha256", F.sha2("content", 256))


def generated(spark: SparkSession, domains: int) -> DataFrame:
    """Sources of so many domains, made on the executors: six files each, in packages d0, d1, ...; the same at every call."""
    names = {"TicketDesk": "Desk{i}", "TicketBook": "Book{i}", "PaperBook": "Paper{i}", "TicketRows": "Rows{i}", "Ticket": "Item{i}"}
    parts = [(p, t) for p, t in DESK if p.startswith("shop/")]
    base = spark.range(domains).select(F.col("id").cast("string").alias("i"))
    out = None
    for k, (path, text) in enumerate(parts):
        def made(x: str):
            c = F.lit(x)
            for old, new in names.items():
                c = F.replace(c, F.lit(old), F.concat(F.lit(new.split("{")[0] + "_"), F.col("i")))
            for old, new in (("shop", "d"), ("/desk", "/desk"), ("TICKET", "TICKET_")):
                c = F.replace(c, F.lit(old), F.concat(F.lit(new), F.col("i")))
            return c

        rows = base.select((F.col("i").cast("int") * len(parts) + k).alias("file_id"), F.lit(path.rsplit(".", 1)[1]).alias("kind"), made(path).alias("path"), made(text).alias("text"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("content", F.encode("text", "UTF-8")).withColumn("sha256", F.sha2("content", 256))
