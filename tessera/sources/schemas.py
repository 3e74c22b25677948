"""Explicit schemas of all sources; sparse nested JSON is never inferred."""

from __future__ import annotations

VULN = "struct<cve:string,cwe:string,cvss_v3_score:double,cvss_v3_vector:string,cvss_v4_score:double,cvss_v4_vector:string>"
ADVISORY = f"struct<advisory_id:string,url:string,year:int,title:string,vendor:string,cves:array<string>,cwes:array<string>,vulns:array<{VULN}>,affected_text:string,error:string>"
ADVISORY_FILE = f"id string, title string, vendor string, year int, url string, cves array<string>, cwes array<string>, overview string, vulns array<{VULN}>"
SIGNAL = "struct<kev:boolean,kev_date:string,epss:double,epss_percentile:double>"
SCORE = "struct<score:double,severity:string,vector:string,ver:string>"
NVD = "struct<id:string,description:string,published:string,lastModified:string,vulnStatus:string,cwes:array<string>,metric:struct<method:string,score:double,severity:string,vector:string,source:string>,references:array<string>,source:string,error:string>"
FINDING = "device string, vendor string, product string, cve string, component string, tier string, arm string, cwe string, cvss_v3_score string, severity string, av string, av_source string, ac string, pr string, ui string, kev string, epss string, source_advisory string"
DEVICE = "device string, vendor string, product string, base_platform string, advisory_count string, cve_count string, oss_cve string, vendor_cve string, oss_components string"
CODE = "struct<cve:string,repo:string,commit:string,file:string,vuln_code:string,patched_code:string,src:string,commits_found:int>"
RUN_BATCH = "cve string, cwe string, component string, vuln_version string, patched_version string, ref_basis string, vuln_crash boolean, patched_crash boolean, signal string, verdict string, stage string, detail string, method string"
RUN_PACKAGES = "cve string, package string, versions array<struct<version:string,installed:boolean,triggered:boolean,expect_trigger:boolean,correct:boolean,exit_code:int,timeout:boolean,evidence:array<string>,output_tail:string>>, discriminates boolean"
VERDICT = "cve string, device string, vendor string, product string, cwe string, av string, sev string, kev boolean, epss double, tier string, source_class string, exposure string, reachability string, has_code_pair boolean, final_vex string, justification string, basis string, estimate_confidence double, evidence_tier string, route string"
KNOWLEDGE = "components array<struct<key:string,name:string,cpe_product:string,versions:map<string,array<struct<id:string,sev:string,av:string,kev:boolean,epss:double,cvss:double>>>>>"
_PROPERTIES = "array<struct<name:string,value:string>>"
INVENTORY = (
    "bomFormat string, specVersion string, serialNumber string, version int, "
    f"metadata struct<component:struct<type:string,`bom-ref`:string,name:string,version:string,purl:string,cpe:string,properties:{_PROPERTIES}>>, "
    f"components array<struct<type:string,`bom-ref`:string,name:string,version:string,cpe:string,purl:string,tags:array<string>,properties:{_PROPERTIES}>>, "
    f"vulnerabilities array<struct<`bom-ref`:string,id:string,ratings:array<struct<score:double,severity:string,method:string,vector:string>>,cwes:array<int>,affects:array<struct<ref:string>>,properties:{_PROPERTIES}>>, "
    "dependencies array<struct<ref:string,dependsOn:array<string>>>"
)
BUILD_RUN = "cve string, build_ok int, critic_ok int, seconds int, marker string"
