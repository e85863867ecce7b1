"""Compare Spark result types with DuckDB result types of every oracle twin (CLI)."""
import sys; import os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))); sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from prism.session import local_session
spark=local_session(); spark.sparkContext.setLogLevel('ERROR')
import __spark_entry__ as E
from oracle_check import duck
sf='/root/testdata/sf0.001'
con = duck(sf)
M = {'int':'INTEGER','bigint':'BIGINT','double':'DOUBLE','string':'VARCHAR','boolean':'BOOLEAN','date':'DATE',
     'timestamp_ntz':'TIMESTAMP','float':'FLOAT','smallint':'SMALLINT','tinyint':'TINYINT'}
for n, sql in E.oracle_sql().items():
    try:
        df = E.queries()[n](spark, sf)
        st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        rel = con.execute(f"DESCRIBE {sql}").fetchall()
        dt = {r[0]: r[1] for r in rel}
        bad = [(c, st[c], dt.get(c)) for c in st if M.get(st[c], st[c]) != dt.get(c)]
        if bad: print(n, bad, flush=True)
    except Exception as e:
        print(n, 'ERR', str(e)[:200])
