"""JSON-LD of pages on literals."""

import json

from corpusloom.operators import structured as S


def script(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


ORG = {
    "@type": ["LocalBusiness", "Store"], "name": "Pier", "url": "u", "logo": {"url": "l.png"}, "address": {"@type": "PostalAddress", "streetAddress": " 1 Quay ", "addressCountry": {"name": "US"}, "postalCode": 123},
    "founder": [{"name": "Ann", "sameAs": ["https://x.com/a", "https://www.LinkedIn.com/in/ann"], "image": {"url": "a.png"}}, {"jobTitle": "no name"}, "text"], "employee": {"name": "Bob", "jobTitle": "Mate", "image": "b.png"},
    "contactPoint": [{"telephone": "1", "contactType": "sales"}, "text", {"email": "e"}],
}
PERSON = {"@type": "Person", "name": "Cy", "jobTitle": "CTO", "email": "c@x.org", "telephone": "9", "sameAs": "https://linkedin.com/in/cy"}
PAGES = [
    (1, "<p>" + script([{"@context": "x", "@graph": [[ORG], PERSON]}, {"@type": "Organization", "name": "Second"}])), (2, script("{broken") + script(PERSON)), (3, None), (4, script("5") + script('"x"') + script("[]")), (5, "ld+json"),
    (6, script({"a": {"b": [{"address": {"@type": ["X", "PostalAddress"], "addressLocality": "Deep"}}]}, "z": {"@type": "PostalAddress", "streetAddress": "Later"}})), (7, script({"@type": "Person", "name": ""}) + script({"name": "no type"})),
    (8, script({"@graph": [{"address": "5 Dock Road, Sea"}], "a": {"@type": "PostalAddress", "streetAddress": "First by name"}, "b": {"address": "short"}})),
]


def test_nodes_and_what_they_say(spark):
    pages = spark.createDataFrame(PAGES, "page int, html string")
    found = S.nodes(pages, "page", "html")
    assert sorted((r.page, r.block, r.kind) for r in found.collect()) == [(1, 0, "localbusiness"), (1, 0, "organization"), (1, 0, "person"), (2, 1, "person"), (6, 0, ""), (7, 0, "person"), (7, 1, ""), (8, 0, "")]
    org = {r.page: r for r in S.organisations(found, "page").collect()}
    assert set(org) == {1} and org[1].asDict() == {"page": 1, "name": "Pier", "type": "localbusiness", "description": None, "url": "u", "logo": "l.png", "address": org[1].address} and json.loads(org[1].address) == ORG["address"]
    got = [(r.page, r.name, r.role, r.email, r.phone, r.linkedin, r.photo, r.confidence) for r in S.people(found, "page").orderBy("page", "block", "pos", "n").collect()]
    cy = ("Cy", "CTO", "c@x.org", "9", "https://linkedin.com/in/cy", None, 0.95)
    assert got == [(1, "Ann", "Founder", None, None, "https://www.LinkedIn.com/in/ann", "a.png", 0.95), (1, "Bob", "Mate", None, None, None, "b.png", 0.95), (1, *cy), (2, *cy)]
    assert [(r.page, r.phone, r.email, r.contact_type) for r in S.contact_points(found, "page").orderBy("n").collect()] == [(1, "1", None, "sales"), (1, None, "e", None)]


def test_postal_addresses(spark):
    got = {r.page: r.address for r in S.postal_addresses(spark.createDataFrame(PAGES, "page int, html string"), "page", "html").collect()}
    assert got == {1: "1 Quay, 123, US", 6: "Deep", 8: "5 Dock Road, Sea"}
