"""Table schemas."""

from pyspark.sql import types as T

#: column -> SQL type of a transaction table
TRANSACTION = {
    "tx_id": "string", "date": "date", "amount": "double", "currency": "string", "raw_label": "string",
    "channel": "string", "mcc": "int", "category_label": "string", "merchant_label": "string",
}
GAZETTEER = ["alias", "merchant_id", "display_name"]

#: field -> SQL type of a request's transaction
REQUEST_TYPES = {
    "tx_id": "string", "date": "string", "amount": "double", "currency": "string", "raw_label": "string",
    "channel": "string", "mcc": "int",
}
#: Requests are parsed as text, so that a value of another type is seen and not dropped.
REQUEST_TRANSACTION = T.StructType([T.StructField(name, T.StringType()) for name in REQUEST_TYPES])
REQUEST = T.StructType([T.StructField("transactions", T.ArrayType(REQUEST_TRANSACTION))])

DRIFT_SUMMARY = (
    "psi_topk double, oov_rate double, ks_confidence_stat double, ks_confidence_pvalue double, "
    "largest_label_shift struct<class:string,train:double,prod:double,abs_delta:double>, "
    "alerts struct<psi_topk_gt_threshold:boolean,label_shift_gt_threshold:boolean>, "
    "thresholds struct<psi_alert:double,shift_alert:double>"
)
