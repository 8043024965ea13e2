"""Schemas of the twelve stores. Absent and null are one; flags that are filtered by are 0 or 1."""

from __future__ import annotations

VERSION = 2

STORES = {
    "files": "id string, name string, type string, kind string, collection string, note string, size long, tags array<string>, vins array<string>, fins array<string>, starred boolean, vinScan long, inFiles int, docId string, blobId string, trashedWith string, searchText string, createdAt long, updatedAt long, deletedAt long, rev long",
    "blobs": "id string, blob binary, size long, sha256 string",
    "thumbs": "id string, blob binary",
    "documents": "id string, li string, ver string, title string, reason string, fgroup string, date string, validity string, text string, pages int, ocr boolean, noText boolean, err boolean, filename string, size long, mtime long, star boolean, edited map<string,int>, added long, fileId string, rev long",
    "tools": "id string, no string, qty string, toolNo string, svcGrp string, ct string, desc string, location string, year string, note string, note2 string, comment string, photo string, wis string, version string, catalogName string, catalogDesc string, price double, star boolean, offered boolean, edited map<string,int>, validities array<string>, rev long",
    "photos": "id string, blob binary",
    "ros": "id string, ro string, roKey string, vehicle string, vin string, tag string, mileage string, color string, opened string, customer string, advisor string, phone string, email string, scanText string, lines array<struct<id:string,text:string,op:string>>, roConflict string, createdAt long, updatedAt long, deletedAt long, rev long",
    "vehicles": "vin string, fin string, series string, model string, checkDigit boolean, status string, confirmedAt long, sources array<string>, notes string, createdAt long, updatedAt long, rev long",
    "links": "id string, fromType string, fromId string, toType string, toId string, kind string, source string, li string, ver string, createdAt long, rev long",
    "jobs": "id string, type string, state string, inputIds array<string>, meta string, progress double, note string, result string, error string, attempts int, owner string, createdAt long, updatedAt long, startedAt long, finishedAt long, heartbeat long, rev long",
    "settings": "key string, value string, rev long",
    "log": "id long, t long, level string, app string, src string, msg string, stack string",
}

KEYS = {name: {"vehicles": "vin", "settings": "key"}.get(name, "id") for name in STORES}
