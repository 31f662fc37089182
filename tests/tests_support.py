"""Posts for small fixtures."""

from corpusloom.operators import model

POST = "z_pk long, zuri string, ztext string, zcreatedat double, zauthordid string, zauthorhandle string, zparenturi string, zrooturi string, zisrootpost long, zdepth long, zaccount long, zreplytreestatus string"


def posts(spark, rows):
    return model.posts(spark.createDataFrame(rows, POST))


def root(pk, account=1, text="root", at=0.0):
    return (pk, f"r{pk}", text, at, f"outlet{account}", f"outlet{account}.example", None, f"r{pk}", 1, 0, account, "complete")


def reply(pk, author, to=1, at=None, handle=None, text="reply", depth=1, parent=None):
    return (pk, f"p{pk}", text, float(pk) if at is None else at, author, handle, parent or f"r{to}", f"r{to}", 0, depth, None, "complete")
