"""Twelve valid sales of a small bookshop chain and helpers to write them as CSV."""

from __future__ import annotations

import csv
from pathlib import Path

from tallyspark.contract import RAW_COLUMNS

NAME, RUN = "NOMBRE RESERVADO", "7.654.321-6"  # personal values, which must never be stored

# Moment, channel, SKU, discount, amount, shop, customer number, birth, gender. Birthdays on
# the day of the sale, the day after and on 29 February; one refund; two customers return.
_ROWS = """
2023-01-03T08:12:30 WEB 310 0.1 18990.0 12 1 1988-05-17 2
2023-01-03T21:40:00 POS 325 0 7490.0 14 2 1971-11-02 1
2023-02-14T12:00:00 APP 310 0.2 15192.0 14 3 2001-02-14 2
2023-02-28T23:30:00 WEB 347 0 3250.75 15 4 2000-02-29 1
2023-04-09T10:05:10 CCT 325 0.05 7115.5 12 5 1964-04-10 0
2023-05-22T17:17:17 POS 388 0 -3250.75 15 6 1999-12-31 4
2023-07-01T00:00:00 APR 347 0.5 1625.25 12 1 1988-05-17 2
2023-08-30T19:59:59 WPR 310 0 21100.0 17 7 1950-08-30 0
2023-09-18T13:45:00 APP 388 0.15 44200.0 14 8 2010-10-01 1
2023-10-31T16:20:00 POS 325 0 7490.0 12 2 1971-11-02 1
2023-12-24T11:11:11 CCT 402 0.3 9933.25 17 9 1993-03-08 5
2023-12-31T23:59:59 WEB 402 0 14190.5 15 3 2001-02-14 2
"""


def valid_rows() -> list[dict[str, str]]:
    rows = []
    for position, line in enumerate(_ROWS.strip().split("\n")):
        moment, channel, sku, discount, amount, shop, customer, birth, gender = line.split(" ")
        rows.append(
            {
                "FECHA": moment,
                "CANAL": channel,
                "SKU": sku,
                "PRODUCTO": f"LIBRO {sku}",
                "UNIDADES": "1",
                "PORCENTAJE DESCUENTO": discount,
                "MONTO APLICADO": amount,
                "BOLETA": str(5000 + 7 * position),
                "LOCAL": shop,
                "CODIGO CLIENTE": f"c0ffee00-b00c-4a1e-9d0{customer}-00000000000{customer}",
                "RUN CLIENTE": RUN,
                "NOMBRES": NAME,
                "APELLIDOS": NAME,
                "FECHA NACIMIENTO": birth,
                "GÉNERO": gender,
            }
        )
        assert tuple(rows[-1]) == RAW_COLUMNS
    return rows


def write_csv(path: Path, rows: list[dict[str, str]], separator: str = ",") -> str:
    with path.open("w", encoding="utf-8", newline="") as stream:
        writer = csv.DictWriter(
            stream, fieldnames=list(rows[0]), delimiter=separator, lineterminator="\n"
        )
        writer.writeheader()
        writer.writerows(rows)
    return str(path)
